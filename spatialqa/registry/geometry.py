"""Queries over boxes, labels, tiles and detections."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spatialqa.functions import taxonomy
from spatialqa.functions.boxes import Box, appearance_similarity, expand, half_even, iou, pair_geometry, truncated_edges
from spatialqa.operators import detections as D, tiles as T
from spatialqa.operators.fusion import same_object
from spatialqa.operators.nms import nms, valid_detections
from spatialqa.operators.overlap import overlap_join, suffixed
from spatialqa.registry.base import query, tidy
from spatialqa.sources.derived import table, view, with_views

IOU_SQL = ("(greatest(0, least({a}.x+{a}.w, {b}.x+{b}.w)-greatest({a}.x,{b}.x)) * greatest(0, least({a}.y+{a}.h, {b}.y+{b}.h)-greatest({a}.y,{b}.y)))"
           " / cast({a}.w*{a}.h + {b}.w*{b}.h - greatest(0, least({a}.x+{a}.w, {b}.x+{b}.w)-greatest({a}.x,{b}.x)) * greatest(0, least({a}.y+{a}.h, {b}.y+{b}.h)-greatest({a}.y,{b}.y)) as double)")
COMMON_SQL = "(greatest(0, least({a}.x+{a}.w, {b}.x+{b}.w)-greatest({a}.x,{b}.x)) * greatest(0, least({a}.y+{a}.h, {b}.y+{b}.h)-greatest({a}.y,{b}.y)))"


def iou_sql(a: str, b: str) -> str:
    return IOU_SQL.format(a=a, b=b)


def common_sql(a: str, b: str) -> str:
    return COMMON_SQL.format(a=a, b=b)


def group_sql(column: str) -> str:
    parts = " ".join(f"when {column} in ({', '.join(repr(n) for n in names)}) then '{g}'" for g, names in taxonomy.GROUP_MEMBERS.items())
    return f"(case {parts} else 'other' end)"


# The greedy loop itself: rows of a group in order, carrying the boxes kept so far.
KEPT_CTE = f"""with recursive ranked as (
  select *, row_number() over (partition by scene_id, category order by confidence desc, seq) as rn from boxes),
walk as (
  select scene_id, category, rn, det_id, true as ok, [{{'x':x,'y':y,'w':w,'h':h}}] as kept from ranked where rn = 1
  union all
  select n.scene_id, n.category, n.rn, n.det_id, n.ok,
    case when n.ok then list_append(n.kept, {{'x':n.x,'y':n.y,'w':n.w,'h':n.h}}) else n.kept end
  from (select r.*, k.kept, len(list_filter(k.kept, lambda o: {iou_sql('o', 'r')} > 0.5)) = 0 as ok
        from walk k join ranked r on r.scene_id = k.scene_id and r.category = k.category and r.rn = k.rn + 1) n)
"""
PAIRS_SQL = f"""
select a.scene_id, a.category, a.det_id as id_a, b.det_id as id_b, round({iou_sql('a', 'b')}, 6) as iou
from boxes a join boxes b on a.scene_id = b.scene_id and a.category = b.category and a.det_id < b.det_id
where {iou_sql('a', 'b')} > 0.5"""
KEPT_SQL = KEPT_CTE + "select w.scene_id, w.category, w.det_id, round(r.confidence, 6) as confidence from walk w join ranked r using (det_id) where w.ok"


def over(sql: str, name: str) -> str:
    """``sql`` with the derived view ``name`` for its table ``boxes``."""
    return with_views(sql.replace("from boxes", f"from {name}").replace("join boxes", f"join {name}"), name)


def _pairs(boxes: DataFrame) -> DataFrame:
    boxes = boxes.select("scene_id", "category", "det_id", *"xywh")
    value = iou(suffixed("a"), suffixed("b"))
    pairs = overlap_join(boxes, boxes, ["scene_id", "category"], (F.col("det_id_a") < F.col("det_id_b")) & (value > 0.5))
    return tidy(pairs.select("scene_id", "category", F.col("det_id_a").alias("id_a"), F.col("det_id_b").alias("id_b"), value.alias("iou")))


@query("overlap_pairs", over(PAIRS_SQL, "fx_boxes"))
def overlap_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(view(spark, folder, "fx_boxes"))


@query("overlap_pairs_mixed", over(PAIRS_SQL, "fx_mixed"))
def overlap_pairs_mixed(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(view(spark, folder, "fx_mixed"))


@query("nms_kept", over(KEPT_SQL, "fx_boxes"))
def nms_kept(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(nms(view(spark, folder, "fx_boxes"), 0.5).select("scene_id", "category", "det_id", "confidence"))


@query("nms_mixed", over(KEPT_SQL, "fx_mixed"))
def nms_mixed(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(nms(view(spark, folder, "fx_mixed"), 0.5).select("scene_id", "category", "det_id", "confidence"))


@query("nms_limited", over(KEPT_CTE + """
select scene_id, det_id from (
  select r.scene_id, r.det_id, row_number() over (partition by r.scene_id order by r.confidence desc, r.seq) as n
  from walk w join ranked r using (det_id) where w.ok) t where n <= 40""", "fx_boxes"))
def nms_limited(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(nms(view(spark, folder, "fx_boxes"), 0.5, limit=40).select("scene_id", "det_id"))


@query("valid_detections", """
with raw as (select l_orderkey as id, l_linenumber as n, l_extendedprice/40 - 20 as x0, l_quantity*20 - 30 as y0,
  l_extendedprice/40 - 20 + l_discount*900 as x1, l_quantity*20 - 30 + l_tax*700 as y1, l_discount*10 as confidence from lineitem)
select id, n, cast(floor(greatest(x0,0)) as bigint) as x, cast(floor(greatest(y0,0)) as bigint) as y,
  cast(ceil(least(x1,1800)) as bigint) - cast(floor(greatest(x0,0)) as bigint) as w,
  cast(ceil(least(y1,1000)) as bigint) - cast(floor(greatest(y0,0)) as bigint) as h
from (select id, cast(n as bigint) as n, x0, y0, x1, y1, confidence from raw) where confidence between 0.3 and 1 and x1 > x0 and y1 > y0
  and cast(ceil(least(x1,1800)) as bigint) > cast(floor(greatest(x0,0)) as bigint)
  and cast(ceil(least(y1,1000)) as bigint) > cast(floor(greatest(y0,0)) as bigint)""")
def valid(spark: SparkSession, folder: str) -> DataFrame:
    x0, y0 = F.col("l_extendedprice") / 40 - 20, F.col("l_quantity") * 20 - 30
    raw = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), x0.alias("x0"), y0.alias("y0"),
                                                  (x0 + F.col("l_discount") * 900).alias("x1"), (y0 + F.col("l_tax") * 700).alias("y1"),
                                                  (F.col("l_discount") * 10).alias("confidence"), F.lit("tree").alias("category"))
    return tidy(valid_detections(raw, F.lit(1800), F.lit(1000), 0.3).select("id", "n", *"xywh"))


SCENES_SQL = "scenes as (select o_orderkey as scene_id, 300+mod(o_orderkey*37,1500) as width, 200+mod(o_orderkey*53,1100) as height from orders)"
STARTS_SQL = ("list_distinct(list_append(range(0, greatest(0,{len}-{size})+1, cast(greatest(1, round_even({size}*(1-{ov}),0)) as bigint)), greatest(0,{len}-{size})))")


def _scenes(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(key.alias("scene_id"), (300 + key * 37 % 1500).alias("width"), (200 + key * 53 % 1100).alias("height"))


def tiles_sql(size: int, overlap: float, prefix: str = "") -> str:
    axis = lambda length: f"list_sort({STARTS_SQL.format(len=length, size=size, ov=overlap)})"
    return f"""select scene_id, '{prefix}tile_' || lpad(cast(r-1 as varchar),2,'0') || '_' || lpad(cast(c-1 as varchar),2,'0') as tile_id,
  cast(ys[r] as bigint) as y, cast(xs[c] as bigint) as x, cast(least({size}, width-xs[c]) as bigint) as w, cast(least({size}, height-ys[r]) as bigint) as h
from (select *, unnest(range(1, len(xs)+1)) as c from (select *, unnest(range(1, len(ys)+1)) as r from (
  select *, {axis('height')} as ys, {axis('width')} as xs from scenes)))"""


@query("tiles", f"with {SCENES_SQL} {tiles_sql(512, 0.25)}")
def tiles(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(T.tiles(_scenes(spark, folder), 512, 0.25).select("scene_id", "tile_id", *"yxwh"))


@query("multiscale_tiles", f"""with {SCENES_SQL}, every as (
  select 0 as pos, * from ({tiles_sql(512, 0.25, 's512_')}) union all select 1, * from ({tiles_sql(768, 0.25, 's768_')}))
select scene_id, tile_id, y, x, w, h from (select *, row_number() over (partition by scene_id, x, y, w, h order by pos) as n from every) t where n = 1""")
def multiscale(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(T.multiscale_tiles(_scenes(spark, folder), 512, (512, 768)).select("scene_id", "tile_id", *"yxwh"))


@query("truncated_detections", with_views("""
select det_id, scene_id, concat_ws(',', case when wx0>0 and x-wx0<=12 then 'left' end, case when wy0>0 and y-wy0<=12 then 'top' end,
  case when wx1<1800 and wx1-(x+w)<=12 then 'right' end, case when wy1<1200 and wy1-(y+h)<=12 then 'bottom' end) as edges,
  greatest(0,x-192) as px0, greatest(0,y-192) as py0, least(1800,x+w+192) as px1, least(1200,y+h+192) as py1 from fx_detections""", "fx_detections"))
def truncated(spark: SparkSession, folder: str) -> DataFrame:
    df = view(spark, folder, "fx_detections")
    window = Box.corners(F.col("wx0"), F.col("wy0"), F.col("wx1"), F.col("wy1"))
    edges = truncated_edges(Box.of(), window, F.lit(1800), F.lit(1200))
    wide = expand(Box.of(), 192, F.lit(1800), F.lit(1200))
    return tidy(df.select("det_id", "scene_id", F.concat_ws(",", edges).alias("edges"), wide.x.alias("px0"), wide.y.alias("py0"),
                          wide.right.alias("px1"), wide.bottom.alias("py1")))


RAW_LABELS = [" Stone Lamp.", "war_banner", "石灯", "column", "unknown_xyz", "Tree", "grass  ground", "spirit stone", "ROCK", "wooden box", "fog", "platform."]
LABEL_SQL = "list_extract([" + ", ".join(f"'{v}'" for v in RAW_LABELS) + "], cast(mod(p_partkey,12) as int)+1)"


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    names = F.array(*(F.lit(v) for v in RAW_LABELS))
    return table(spark, folder, "part").withColumn("label", F.get(names, (F.col("p_partkey") % 12).cast("int")))


CLEAN_SQL = "trim(regexp_replace(replace(trim(lower(trim({c})), '. '), '_', ' '), '\\s+', ' ', 'g'))"
NORMAL_SQL = ("coalesce(map {" + ", ".join(f"'{k}': '{v}'" for k, v in taxonomy.ALIAS_OF.items()) + "}[" + CLEAN_SQL.format(c="label") + "], replace("
              + CLEAN_SQL.format(c="label") + ", ' ', '_'))")


@query("normalized_labels", f"""
with n as (select p_partkey, label, {NORMAL_SQL} as name from (select p_partkey, {LABEL_SQL} as label from part))
select p_partkey, label, case when {group_sql('name')} <> 'other' or name in ('tree','rock','building','other') then name end as category,
  {group_sql('name')} as grp from n""")
def normalized_labels(spark: SparkSession, folder: str) -> DataFrame:
    df = _labels(spark, folder)
    name = taxonomy.normalize_category(F.col("label"))
    spelled = taxonomy.normalize_category(F.col("label"), F.lit("other"))
    return tidy(df.select("p_partkey", "label", name.alias("category"), taxonomy.category_group(spelled).alias("grp")))


VOCABULARY = ["copper", "small", "steel", "rusty", "blue", "small plate"]


@query("matched_labels", """
with v as (select unnest(['copper','small','steel','rusty','blue','small plate']) as name),
hits as (select p_partkey, p_name, lower(trim(p_name)) as clean, list(v.name) filter (regexp_matches(lower(p_name), '(^|\\W)' || v.name || '($|\\W)')) as found,
         max(case when lower(trim(p_name)) = v.name then v.name end) as exact from part, v group by all)
select p_partkey, p_name, coalesce(exact, case when len(found) = 1 then found[1] end) as matched from hits""")
def matched_labels(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(table(spark, folder, "part").select("p_partkey", "p_name", taxonomy.match_label(F.col("p_name"), VOCABULARY).alias("matched")))


SMALL_SQL = "(" + ", ".join(repr(n) for n in taxonomy.SMALL) + ")"
ROUTE_SQL = f"""routed as (select det_id, scene_id, category, w*h as area, source, confidence,
  (wx0>0 and x-wx0<=12) or (wy0>0 and y-wy0<=12) or (wx1<1800 and wx1-(x+w)<=12) or (wy1<1200 and wy1-(y+h)<=12) as cut,
  confidence < (case when w*h/cast(2160000 as double) < 0.001 then 0.25 when w*h/cast(2160000 as double) >= 0.05 then 0.5 else 0.4 end) as low,
  category in {SMALL_SQL} and source in ('tile','redetection') as protected from fx_detections)"""


def _routed(spark: SparkSession, folder: str) -> DataFrame:
    df = view(spark, folder, "fx_detections")
    window = Box.corners(F.col("wx0"), F.col("wy0"), F.col("wx1"), F.col("wy1"))
    cut = F.size(truncated_edges(Box.of(), window, F.lit(1800), F.lit(1200))) > 0
    return D.route_candidates(df.withColumn("is_truncated", cut).withColumn("sources", F.array("source")), F.lit(1800 * 1200))


@query("routed_candidates", with_views(f"""with {ROUTE_SQL}
select det_id, not cut and not (low and not protected) as is_kept, cut or (low and protected) as is_review,
  case when not cut and low and not protected then 'low_confidence' end as reject_reason,
  case when cut then 'unresolved_truncation' when low and protected then 'low_confidence_small_object' end as review_reason from routed""", "fx_detections"))
def routed(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(_routed(spark, folder).select("det_id", "is_kept", "is_review", "reject_reason", "review_reason"))


@query("small_object_report", with_views(f"""with {ROUTE_SQL}
select scene_id, count(*) as small_objects, count(*) filter (source='global') as by_global, count(*) filter (source='tile') as by_tile,
  count(*) filter (source<>'global') as tile_only from routed where not cut and not (low and not protected) and area < 2160 group by scene_id""", "fx_detections"))
def small_objects(spark: SparkSession, folder: str) -> DataFrame:
    return tidy(D.small_object_report(_routed(spark, folder).filter("is_kept"), F.lit(1800 * 1200)))


@query("classified_elements", with_views("""
select det_id, case when category='grass_ground' then 'terrain' else 'instance' end as element_type,
  case when category='grass_ground' then 'base_terrain' when category in ('tree','flower') then 'vegetation' when category='building' then 'building' else 'small_object' end as layer_group,
  case when category='grass_ground' then 10 when category in ('tree','flower') then 30 when category='building' then 40 else 60 end::bigint as ownership_priority,
  false as uncertain, count(*) over (partition by scene_id, category) as repeats, round(w*h/cast(2160000 as double),6) as area_ratio from fx_boxes""", "fx_boxes"))
def classified(spark: SparkSession, folder: str) -> DataFrame:
    out = D.classify_elements(view(spark, folder, "fx_boxes"), F.lit(1800 * 1200))
    return tidy(out.select("det_id", "element_type", "layer_group", "ownership_priority", "uncertain", "repeats", "area_ratio"))


def _scene_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Category lists of scenes of 40 parts, in part order."""
    name = taxonomy.normalize_category(F.col("label"), F.lit("mystery"))
    return _labels(spark, folder).select(F.floor(F.col("p_partkey") / 40).alias("scene_id"), name.alias("category"), F.col("p_partkey").alias("seq"))


SCENE_LABELS_SQL = f"""listed as (select cast(floor(p_partkey/40) as bigint) as scene_id, p_partkey as seq,
  case when {group_sql('name')} <> 'other' or name in ('tree','rock','building','other') then name else 'mystery' end as category
  from (select p_partkey, {NORMAL_SQL} as name from (select p_partkey, {LABEL_SQL} as label from part))),
once as (select scene_id, category, min(seq) as seq from listed group by all)"""
LAYERS_SQL = "list_position([" + ", ".join(f"'{g}'" for g in taxonomy.MEMBERS) + "], " + group_sql("category") + ")"


@query("layer_plan", f"""with {SCENE_LABELS_SQL},
placed as (select *, coalesce({LAYERS_SQL}, 99) as layer_no, {group_sql('category')} as layer from once)
select scene_id, layer, row_number() over (partition by scene_id order by layer_no) - 1 as layer_order, categories from (
  select scene_id, layer_no, layer, string_agg(category, ',' order by seq) as categories from placed group by all)""")
def layer_plan(spark: SparkSession, folder: str) -> DataFrame:
    out = D.layer_plan(_scene_labels(spark, folder))
    return tidy(out.select("scene_id", "layer", "layer_order", F.concat_ws(",", "categories").alias("categories")))


PROMPT_SQL = "(case " + " ".join(
    f"when category in ({', '.join(repr(n) for n in names)}) then {i}" for i, names in enumerate(taxonomy.PROMPT_GROUPS.values())) + " else 5 end)"
PROMPT_NAMES_SQL = "[" + ", ".join(f"'{g}'" for g in taxonomy.PROMPT_GROUPS) + "]"


@query("category_batches", f"""with {SCENE_LABELS_SQL},
placed as (select *, {PROMPT_SQL} as rank, case when {PROMPT_SQL} < 5 then {PROMPT_NAMES_SQL}[{PROMPT_SQL}+1] else {group_sql('category')} end as batch_group from once),
numbered as (select *, min(seq) over g as first, (row_number() over (partition by scene_id, rank, batch_group order by seq) - 1)//2 as batch_index from placed window g as (partition by scene_id, rank, batch_group))
select scene_id, batch_group, batch_index, categories, row_number() over (partition by scene_id order by rank, first, batch_index) - 1 as batch_no from (
  select scene_id, rank, first, batch_group, batch_index, string_agg(category, ',' order by seq) as categories from numbered group by all)""")
def category_batches(spark: SparkSession, folder: str) -> DataFrame:
    out = T.category_batches(_scene_labels(spark, folder), 2)
    return tidy(out.select("scene_id", "batch_group", "batch_index", F.concat_ws(",", "categories").alias("categories"), "batch_no"))


@query("restored_boxes", """
with raw as (select l_orderkey as id, l_linenumber::bigint as n, l_partkey as p, mod(l_orderkey,2)=0 as unit,
  case when mod(l_orderkey,2)=0 then l_discount else l_discount*300-9.5 end as x0, case when mod(l_orderkey,2)=0 then l_tax else l_tax*200-3.25 end as y0,
  case when mod(l_orderkey,2)=0 then l_discount+l_quantity/55 else l_discount*300+l_quantity end as x1,
  case when mod(l_orderkey,2)=0 then l_tax+l_quantity/60 else l_tax*200+l_quantity/3 end as y1 from lineitem),
px as (select *, case when unit then x0*120 else x0 end as a, case when unit then y0*90 else y0 end as b, case when unit then x1*120 else x1 end as c,
  case when unit then y1*90 else y1 end as d, not unit or (x0 between 0 and 1 and y0 between 0 and 1 and x1 between 0 and 1 and y1 between 0 and 1) as good from raw),
cut as (select *, floor(greatest(0,a))::bigint as l, floor(greatest(0,b))::bigint as t, ceil(least(120,greatest(c,0)))::bigint as r, ceil(least(90,greatest(d,0)))::bigint as m from px)
select id, n, case when good and r>least(l,120) and m>least(t,90) then 100+l end as x, case when good and r>least(l,120) and m>least(t,90) then 200+t end as y,
  case when good and r>least(l,120) and m>least(t,90) then r-l end as w, case when good and r>least(l,120) and m>least(t,90) then m-t end as h from cut""")
def restored(spark: SparkSession, folder: str) -> DataFrame:
    from spatialqa.functions.boxes import restore_box
    unit = F.col("l_orderkey") % 2 == 0
    pick = lambda a, b: F.when(unit, a).otherwise(b)
    d, t, q = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")
    box = F.array(pick(d, d * 300 - 9.5), pick(t, t * 200 - 3.25), pick(d + q / 55, d * 300 + q), pick(t + q / 60, t * 200 + q / 3))
    out = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"),
                                                  restore_box(box, Box(F.lit(100), F.lit(200), F.lit(120), F.lit(90)), unit).alias("b"))
    return tidy(out.select("id", "n", "b.x", "b.y", "b.w", "b.h"))


@query("split_observations", f"""
with obs as (select p_partkey, label, {NORMAL_SQL} as name, p_retailprice/1000 as confidence, p_size from (select *, {LABEL_SQL} as label from part)),
c as (select *, case when {group_sql('name')} <> 'other' or name in ('tree','rock','building','other') then name end as category from obs)
select p_partkey, coalesce(category, label) as category, case when confidence > 1 then 'invalid_confidence' when mod(p_size,7)=0 then 'invalid_bbox' when category is null then 'category_unknown' end as reason,
  case when confidence > 1 or mod(p_size,7)=0 or category is null then null else p_size + 10 end::bigint as x,
  case when confidence > 1 or mod(p_size,7)=0 or category is null then null when p_size <= 12 then 'left' else '' end as edges from c""")
def split(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    raw = _labels(spark, folder).select("p_partkey", "label", (F.col("p_retailprice") / 1000).alias("confidence"), F.array(size, F.lit(20.0), F.when(F.col("p_size") % 7 == 0, 0.0).otherwise(30.0), F.lit(40.0)).alias("bbox"),
                                        F.lit("xywh").alias("bbox_format"), F.lit(None).cast("string").alias("coordinate_space"), F.lit(10).alias("wx0"), F.lit(10).alias("wy0"),
                                        F.lit(400).alias("wx1"), F.lit(300).alias("wy1"), F.lit(500).alias("width"), F.lit(400).alias("height"))
    good, bad = D.split_observations(raw, ["tree"])
    edges = F.concat_ws(",", "truncated_edges")
    out = good.select("p_partkey", "category", F.lit(None).cast("string").alias("reason"), "x", edges.alias("edges")).unionByName(
        bad.select("p_partkey", "category", "reason", F.lit(None).cast("bigint").alias("x"), F.lit(None).cast("string").alias("edges")))
    return tidy(out)


@query("appearance_similarity", """
with e as (select vec_id, list_transform(embedding, lambda v: greatest(v,0)::double) as v from embeddings)
select a.vec_id, round(list_sum(list_transform(list_zip(a.v,b.v), lambda p: least(p[1],p[2])))/greatest(list_sum(a.v), list_sum(b.v), 1e-9), 6) as similarity
from e a join e b on b.vec_id = a.vec_id + 1""")
def appearance(spark: SparkSession, folder: str) -> DataFrame:
    plus = F.transform("embedding", lambda v: F.greatest(v.cast("double"), F.lit(0.0)))
    e = table(spark, folder, "embeddings").select("vec_id", plus.alias("v"))
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("u"))
    return tidy(e.join(other, "vec_id").select("vec_id", appearance_similarity(F.col("v"), F.col("u")).alias("similarity")))


GEO_SQL = f"""pairs as (select a.det_id as id_a, b.det_id as id_b, {common_sql('a', 'b')} as common, a.w*a.h as aa, b.w*b.h as ab,
  sqrt(pow((a.x+a.w/2.0)-(b.x+b.w/2.0),2)+pow((a.y+a.h/2.0)-(b.y+b.h/2.0),2))/greatest(1, least(sqrt(a.w*a.w+a.h*a.h), sqrt(b.w*b.w+b.h*b.h))) as distance,
  (a.wx0,a.wy0,a.wx1,a.wy1) <> (b.wx0,b.wy0,b.wx1,b.wy1) as other, a.source as sa, b.source as sb
  from fx_detections a join fx_detections b on a.scene_id=b.scene_id and a.category=b.category and a.det_id < b.det_id where {common_sql('a', 'b')} > 0)"""


@query("same_object_pairs", with_views(f"""with {GEO_SQL}
select id_a, id_b, round(common/least(aa,ab)::double,6) as overlap, round(distance,6) as distance, round(least(aa,ab)/greatest(aa,ab)::double,6) as ratio from pairs
where (common/(aa+ab-common)::double >= 0.45 and distance <= 0.65 and least(aa,ab)/greatest(aa,ab)::double >= 0.35)
   or (common/least(aa,ab)::double >= 0.7 and distance <= 0.65 and least(aa,ab)/greatest(aa,ab)::double >= 0.5)""", "fx_detections"))
def same_object_pairs(spark: SparkSession, folder: str) -> DataFrame:
    df = view(spark, folder, "fx_detections").select("scene_id", "category", "det_id", *"xywh", "wx0", "wy0", "wx1", "wy1")
    pairs = overlap_join(df, df, ["scene_id", "category"], F.col("det_id_a") < F.col("det_id_b"))
    extra = [F.lit(False).alias("is_truncated"), F.array().cast("array<string>").alias("truncated_edges"), F.lit(None).cast("array<double>").alias("appearance"),
             F.lit(None).cast("bigint").alias("parent_id"), F.array().cast("array<bigint>").alias("lineage")]
    side = lambda s: F.struct(*(F.col(f"{c}_{s}").alias(c) for c in ["det_id", *"xywh", "wx0", "wy0", "wx1", "wy1"]), *extra)
    both = pairs.select(side("a").alias("a"), side("b").alias("b"))
    geo = pair_geometry(Box.of("a"), Box.of("b"))
    return tidy(both.filter(same_object("a", "b")).select(F.col("a.det_id").alias("id_a"), F.col("b.det_id").alias("id_b"), *(geo[k].alias(k) for k in ("overlap", "distance", "ratio"))))


ARCHIVE_SQL = """archive as (select det_id as object_id, seq, scene_id, category, x+3 as x, y+2 as y, w, h, case when mod(det_id,3)=0 then 'pass' else 'manual_review' end as status
  from fx_boxes where confidence > 0.8)"""


@query("archive_dedup", with_views(f"""with {ARCHIVE_SQL},
hits as (select n.det_id, n.seq, n.scene_id, bool_or(a.status='pass') as passed, arg_max(a.object_id, ({iou_sql('n', 'a')}, -a.seq)) as matched_id
  from fx_boxes n join archive a on n.scene_id=a.scene_id and n.category=a.category where {iou_sql('n', 'a')} > 0.5 group by all),
firsts as (select scene_id, matched_id, min(seq) as first from hits where not passed group by all)
select n.det_id, h.matched_id, case when h.passed then 'duplicate_archived' when h.seq > f.first then 'duplicate_assigned' end as reject_reason
from fx_boxes n left join hits h using (det_id) left join firsts f on f.scene_id = h.scene_id and f.matched_id = h.matched_id""", "fx_boxes"))
def archive_dedup(spark: SparkSession, folder: str) -> DataFrame:
    new = view(spark, folder, "fx_boxes")
    status = F.when(F.col("det_id") % 3 == 0, "pass").otherwise("manual_review")
    archive = new.filter("confidence > 0.8").select(F.col("det_id").alias("object_id"), "seq", "scene_id", "category", (F.col("x") + 3).alias("x"), (F.col("y") + 2).alias("y"), "w", "h", status.alias("status"))
    return tidy(D.dedup_against_archive(new, archive).select("det_id", "matched_id", "reject_reason"))


@query("capped_objects", with_views("""
with used as (select scene_id, count(*) filter (confidence > 0.9) as existing from fx_boxes group by 1),
r as (select det_id, scene_id, mod(det_id,4)<>0 as is_new, sum(case when mod(det_id,4)<>0 then 1 else 0 end) over (partition by scene_id order by seq) as n from fx_boxes)
select det_id, case when is_new and n > 150 - existing then 'max_objects' end as reject_reason from r join used using (scene_id)""", "fx_boxes"))
def capped(spark: SparkSession, folder: str) -> DataFrame:
    df = view(spark, folder, "fx_boxes").withColumn("is_new", F.col("det_id") % 4 != 0)
    used = df.groupBy("scene_id").agg(F.count_if(F.col("confidence") > 0.9).alias("existing"))
    return tidy(D.cap_objects(df, used, 150).select("det_id", "reject_reason"))


@query("object_limit", with_views("""
with r as (select scene_id, mod(det_id,4)<>0 as is_new, sum(case when mod(det_id,4)<>0 then 1 else 0 end) over (partition by scene_id order by seq) as n from fx_boxes)
select scene_id, count(*) as objects_before_limit, count(*) filter (not (is_new and n > 150)) as objects_after_limit, count(*) filter (is_new and n > 150) > 0 as truncated from r group by 1""", "fx_boxes"))
def limits(spark: SparkSession, folder: str) -> DataFrame:
    df = view(spark, folder, "fx_boxes").withColumn("is_new", F.col("det_id") % 4 != 0)
    none = df.select("scene_id").distinct().withColumn("existing", F.lit(0))
    return tidy(D.object_limit(D.cap_objects(df, none, 150)))


@query("assigned_ids", with_views("""
with used as (select distinct scene_id, category, mod(det_id*7,61)+1 as u from fx_boxes where confidence > 0.7),
free as (select s.scene_id, s.category, n, row_number() over (partition by s.scene_id, s.category order by n) as i from
  (select distinct scene_id, category from fx_boxes) s, range(1, 400) t(n)
  where not exists (select 1 from used u where u.scene_id=s.scene_id and u.category=s.category and u.u=n)),
r as (select det_id, scene_id, category, row_number() over (partition by scene_id, category order by seq) as i from fx_boxes)
select det_id, r.category || '_' || lpad(cast(n as varchar), 3, '0') as object_id from r join free using (scene_id, category, i)""", "fx_boxes"))
def assigned(spark: SparkSession, folder: str) -> DataFrame:
    df = view(spark, folder, "fx_boxes")
    number = (F.col("det_id") * 7 % 61 + 1).cast("string")
    used = df.filter("confidence > 0.7").select("scene_id", F.concat("category", F.lit("_"), F.lpad(number, 3, "0")).alias("object_id"))
    return tidy(D.assign_ids(df, used).select("det_id", "object_id"))


PARENT_SQL = "parents as (select det_id, seq, scene_id, category, x, y, w, h from fx_boxes where confidence < 0.5)"


@query("redetections", with_views(f"""with {PARENT_SQL}, ranked as (select *, row_number() over (partition by scene_id order by seq) as n from parents),
kids as (select k.det_id, p.det_id as parent_id, coalesce(k.category = p.category and {common_sql('k', 'p')}/least(k.w*k.h, p.w*p.h)::double >= 0.7
  and sqrt(pow((k.x+k.w/2.0)-(p.x+p.w/2.0),2)+pow((k.y+k.h/2.0)-(p.y+p.h/2.0),2))/greatest(1, least(sqrt(k.w*k.w+k.h*k.h), sqrt(p.w*p.w+p.h*p.h))) <= 1.25
  and least(k.w*k.h,p.w*p.h)/greatest(k.w*k.h,p.w*p.h)::double >= 0.1, false) as hit, mod(k.det_id,2)=0 as whole
  from fx_boxes k join ranked p on p.scene_id=k.scene_id and p.det_id = k.det_id - 4 and p.n <= 100)
select r.det_id, case when n > 100 then 'budget_exhausted' when bool_or(hit and whole) then 'recovered' else 'unresolved' end as status
from ranked r left join kids on kids.parent_id = r.det_id group by r.det_id, n""", "fx_boxes"))
def redetections(spark: SparkSession, folder: str) -> DataFrame:
    df = view(spark, folder, "fx_boxes")
    parents = df.filter("confidence < 0.5")
    kids = df.withColumn("parent_id", F.col("det_id") - 4).withColumn("is_truncated", F.col("det_id") % 2 != 0)
    return tidy(D.match_redetections(kids, parents)[1].select("det_id", "status"))


@query("remaining_proposals", with_views(f"""with passed as (select * from fx_boxes where confidence > 0.9)
select det_id from fx_boxes p where not exists (select 1 from passed o where o.scene_id=p.scene_id and o.category=p.category and {iou_sql('p', 'o')} > 0.4)""", "fx_boxes"))
def proposals(spark: SparkSession, folder: str) -> DataFrame:
    df = view(spark, folder, "fx_boxes")
    passed = df.withColumn("status", F.when(F.col("confidence") > 0.9, "pass").otherwise("retry"))
    return tidy(D.remaining_proposals(df, passed, ident="det_id").select("det_id"))


@query("recovery_worklist", with_views("""
with regions as (select scene_id, det_id as seq, mod(det_id,3) as kind_order, category, x-mod(x,100) as x, y-mod(y,100) as y, 100 as w, 100 as h,
  category || '|' || (x-mod(x,100)) || '|' || (y-mod(y,100)) || '|100|100' as region_key from fx_boxes),
tried as (select scene_id, region_key, count(*) as n from regions where mod(seq,5)=0 group by all),
listed as (select *, row_number() over (partition by scene_id order by kind_order, seq) as r from regions qualify r <= 12),
once as (select *, row_number() over (partition by scene_id, region_key order by kind_order, seq) as o from listed qualify o = 1)
select scene_id, seq, region_key, coalesce(n,0) as attempt from once left join tried using (scene_id, region_key) where coalesce(n,0) < 2""", "fx_boxes"))
def worklist(spark: SparkSession, folder: str) -> DataFrame:
    df = view(spark, folder, "fx_boxes")
    regions = df.select("scene_id", F.col("det_id").alias("seq"), (F.col("det_id") % 3).alias("kind_order"), "category", (F.col("x") - F.col("x") % 100).alias("x"),
                        (F.col("y") - F.col("y") % 100).alias("y"), F.lit(100).alias("w"), F.lit(100).alias("h"))
    tried = regions.filter("seq % 5 = 0").select("scene_id", D.region_key(F.col("category"), Box.of()).alias("region_key"), F.lit("local_detection").alias("action"))
    return tidy(D.recovery_worklist(regions, tried).select("scene_id", "seq", "region_key", "attempt"))


@query("local_windows", with_views("""
with p as (select *, greatest(w,h) as side, round_even(greatest(w,h)*(case when greatest(w,h)<64 then 1.0 when greatest(w,h)<128 then 0.6 when greatest(w,h)<256 then 0.3 else 0.15 end),0)::bigint as pad from fx_boxes),
s as (select *, least(1800, 512, w+2*pad) as ww, least(1200, 512, h+2*pad) as wh from p)
select det_id, least(greatest(0, x-(ww-w)//2), 1800-ww) as wx, least(greatest(0, y-(wh-h)//2), 1200-wh) as wy, ww, wh from s""", "fx_boxes"))
def windows(spark: SparkSession, folder: str) -> DataFrame:
    df = view(spark, folder, "fx_boxes").withColumn("width", F.lit(1800)).withColumn("height", F.lit(1200))
    return tidy(T.local_windows(df, 512).select("det_id", "wx", "wy", "ww", "wh"))


@query("recovery_windows", with_views("""
with r as (select det_id, x, y, w, h, greatest(0,x-64) as wx, greatest(0,y-64) as wy, least(1800,x+w+64) as wr, least(1200,y+h+64) as wb from fx_boxes),
s as (select *, case when greatest(wr-wx, wb-wy) < 512 then 2 else 1 end::bigint as scale from r)
select det_id, wx, wy, wr, wb, scale, greatest(wx, wx + round_even(7/scale::double,0)::bigint) as gx, least(wr, wx + round_even((7+w)/scale::double,0)::bigint) as gr from s""", "fx_boxes"))
def recovery(spark: SparkSession, folder: str) -> DataFrame:
    df = view(spark, folder, "fx_boxes").withColumn("width", F.lit(1800)).withColumn("height", F.lit(1200))
    out = T.recovery_windows(df, F.lit(1))
    found = T.to_global(Box(F.lit(7), F.lit(9), F.col("w"), F.col("h")), Box.corners(F.col("wx"), F.col("wy"), F.col("wr"), F.col("wb")), F.col("scale").cast("double"))
    return tidy(out.select("det_id", "wx", "wy", "wr", "wb", "scale", found.x.alias("gx"), found.right.alias("gr")))
