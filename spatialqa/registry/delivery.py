"""Queries over recovery, delivery, enhancement, summaries, streams and user scorers."""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from spatialqa.functions import quality as Q, taxonomy
from spatialqa.functions.boxes import Box, appearance_similarity
from spatialqa.operators import detections as D, evaluate as E, fusion as U, objects as B, ownership as O, planning as L, reports as R, rounds as N, runs as M
from spatialqa.registry.base import query, tidy
from spatialqa.registry.geometry import common_sql, iou_sql
from spatialqa.registry.masks import OWN_SQL, PX, H, W, _objects, _owned, eligible, runs, scenes, shapes
from spatialqa.registry.scoring import fusion_input
from spatialqa.registry.work import REQUESTS_SQL
from spatialqa.session import materialize, scratch_folder
from spatialqa.sources import manifest as A
from spatialqa.sources.derived import mask_runs, table, view, with_views
from spatialqa.streaming.rounds import monitor_rounds
from spatialqa.streaming.scorer import run_scorer


@query("recovered_regions", with_views(f"""
with recursive known as (select * from fx_boxes where confidence > 0.97),
fresh as (select * from fx_boxes f where confidence >= 0.35 and mod(det_id,6)<>0 and not exists (select 1 from known k where k.scene_id=f.scene_id and k.category=f.category and {iou_sql('f', 'k')} > 0.4)),
ranked as (select *, row_number() over (partition by scene_id, category order by seq) as rn from fresh),
walk as (select scene_id, category, rn, det_id, true as ok, [{{'x':x,'y':y,'w':w,'h':h}}] as kept from ranked where rn = 1
  union all select n.scene_id, n.category, n.rn, n.det_id, n.ok, case when n.ok then list_append(n.kept, {{'x':n.x,'y':n.y,'w':n.w,'h':n.h}}) else n.kept end
  from (select r.*, k.kept, len(list_filter(k.kept, lambda o: {iou_sql('o', 'r')} > 0.4)) = 0 as ok from walk k join ranked r on r.scene_id=k.scene_id and r.category=k.category and r.rn=k.rn+1) n)
select det_id from walk where ok""", "fx_boxes"))
def recovered(spark: SparkSession, folder: str) -> DataFrame:
    b = view(spark, folder, "fx_boxes").withColumn("is_truncated", F.col("det_id") % 6 == 0)
    return tidy(D.accept_recovered(b, b.filter("confidence > 0.97")).select("det_id"))


@query("accepted_fragments", with_views(f"""with k as (select c.det_id, p.det_id as parent_id, c.seq, c.confidence as score from fx_boxes c join fx_boxes p on p.scene_id=c.scene_id and p.category=c.category and p.det_id=c.det_id - 4*(1+mod(c.det_id,3))
  where {common_sql('c', 'p')}/least(c.w*c.h,p.w*p.h)::double >= 0.7 and sqrt(pow((c.x+c.w/2.0)-(p.x+p.w/2.0),2)+pow((c.y+c.h/2.0)-(p.y+p.h/2.0),2))/greatest(1, least(sqrt(c.w*c.w+c.h*c.h), sqrt(p.w*p.w+p.h*p.h))) <= 1.25
  and least(c.w*c.h,p.w*p.h)/greatest(c.w*c.h,p.w*p.h)::double >= 0.1 and mod(c.det_id,5)<>0 and c.confidence>=0.35 and c.confidence > p.confidence+1e-6 and mod(c.det_id,2) < 1)
select parent_id, det_id from (select *, row_number() over (partition by parent_id order by score desc, seq) as n from k) t where n=1""", "fx_boxes"))
def fragments(spark: SparkSession, folder: str) -> DataFrame:
    look = F.array(F.lit(1.0))
    b = view(spark, folder, "fx_boxes").withColumn("score", F.col("confidence")).withColumn("appearance", look)
    parents = b.withColumn("object_id", F.col("det_id")).withColumn("failures", F.lit(1)).join(b.select("det_id"), "det_id", "left_semi")
    kids = b.withColumn("parent_id", F.col("det_id") - 4 * (1 + F.col("det_id") % 3)).withColumn("is_truncated", F.col("det_id") % 5 == 0).withColumn("failures", F.col("det_id") % 2)
    same = kids.join(b.select(F.col("det_id").alias("parent_id"), "scene_id"), ["parent_id", "scene_id"], "left_semi")
    return tidy(D.accept_fragment(same, parents).select("parent_id", "det_id"))


@query("applied_ownership", with_views(f"""with {OWN_SQL}, t as (select scene_id, y, x, arg_max(owner, ord) as won from lay group by all),
v as (select det_id, count(*) filter (owner=won) as visible_pixels, count(*) filter (owner<>won) as occluded_pixels from lay join t using (scene_id,y,x) group by 1),
s as (select f.det_id as object_id, category, confidence, visible_pixels, occluded_pixels, n from fx_shapes f left join v using (det_id) left join (select det_id, count(*) as n from px group by 1) using (det_id) where category<>'grass_ground')
select object_id, visible_pixels, coalesce(visible_pixels=0 and occluded_pixels>0, false) as fully_occluded, coalesce(visible_pixels>0 and visible_pixels<>n, false) as needs_crop, case when confidence>0.3 then 'pass' else 'retry' end as status from s""", "fx_runs"))
def applied(spark: SparkSession, folder: str) -> DataFrame:
    _, stacked, painted = _owned(spark, folder)
    sizes = M.pixel_count(runs(spark, folder), ["det_id"], "mask_pixels").withColumnRenamed("det_id", "object_id")
    objects = _objects(spark, folder).join(sizes, "object_id", "left").withColumn("asset_path", F.lit("a"))
    out = O.apply_ownership(objects, O.record_pixels(stacked, painted))
    return tidy(out.select("object_id", "visible_pixels", "fully_occluded", "needs_crop", "status"))


@query("audited_masks", with_views("""with r as (select det_id, sum(x1-x0)::bigint as n from fx_runs where mod(det_id,9)<>0 group by 1)
select f.det_id as object_id, case when n is null then 'segmentation_failed: missing mask' when mod(f.det_id,14)=1 then 'segmentation_failed: mask size differs' else 'segmented' end as outcome from fx_shapes f left join r using (det_id)""", "fx_runs"))
def audited(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("object_id")
    objects = shapes(spark, folder).select("scene_id", F.col("det_id").alias("object_id"), F.lit(W).alias("width"), F.lit(H).alias("height"))
    stats = M.pixel_count(runs(spark, folder).filter("det_id % 9 <> 0"), ["scene_id", "det_id"]).withColumnRenamed("det_id", "object_id")
    stats = stats.withColumn("mask_w", F.when(i % 14 == 1, 10).otherwise(W)).withColumn("mask_h", F.lit(H))
    return tidy(B.audit_masks(objects, stats).select("object_id", "outcome"))


@query("enhanced_objects", with_views("""select det_id as object_id, case when mod(det_id,4)=0 or mod(det_id,9)=0 then 'skipped' when mod(det_id,5)=0 then 'failed' when mod(det_id,5)=1 then 'preview_only' when mod(det_id,5)=2 then 'unavailable'
  when mod(det_id,7)=0 then 'pending_review' when confidence>0.5 then 'ready' else 'failed' end as enhancement_status from fx_boxes""", "fx_boxes"))
def enhanced(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("det_id")
    b = view(spark, folder, "fx_boxes")
    objects = b.select("scene_id", i.alias("object_id"), (i % 4 == 0).alias("completion_open"), F.when(i % 9 != 0, "a").alias("asset_path"), F.lit("pass").alias("status"))
    results = b.filter("det_id % 5 > 0").select("scene_id", i.alias("object_id"), F.when(i % 5 == 1, "preview_only").when(i % 5 == 2, "unavailable").otherwise("pending_review").alias("outcome"),
                                                F.when(i % 7 != 0, F.when(F.col("confidence") > 0.5, "ACCEPT").otherwise("REJECT")).alias("verdict"))
    return tidy(B.enhance_objects(objects, results, required=True).select("object_id", "enhancement_status"))


@query("placements", with_views("""select det_id, case when greatest(w,h)<128 then 4 else 2 end::bigint as factor, round((x + case when mod(det_id,3)=0 then 5.5 else w/2.0 end)::double,6) as anchor_x, round((y + case when mod(det_id,3)=0 then 7.25 else h end)::double,6) as anchor_y,
  round(case when mod(det_id,5)=0 then 99.0 when mod(det_id,3)=0 then 42.0 else y+h end::double,6) as z_order, round(least(case when mod(det_id,4)>=3 then 0.25 else 0.3 end, 1)::double,6) as box_threshold from fx_boxes""", "fx_boxes"))
def placements(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("det_id")
    none = F.lit(None).cast("double")
    pivot = lambda v: F.when(i % 3 == 0, F.lit(v))
    earlier = F.when(i % 5 == 0, F.struct(none.alias("center_x"), none.alias("center_y"), none.alias("anchor_x"), none.alias("anchor_y"), none.alias("scale"), F.lit(99.0).alias("z_order"), none.alias("depth")))
    spot = Q.placement(F.col("x"), F.col("y"), F.col("w"), F.col("h"), pivot(5.5), pivot(7.25), none, none, F.when(i % 3 == 0, 42.0).otherwise(0.0), earlier)
    out = view(spark, folder, "fx_boxes").select("det_id", Q.upscale_factor(F.col("w"), F.col("h")).alias("factor"), spot.alias("p"), N.round_threshold(i % 4, 0.30, 0.25).alias("box_threshold"))
    return tidy(out.select("det_id", "factor", "p.anchor_x", "p.anchor_y", "p.z_order", "box_threshold"))


@query("scene_summary", with_views(f"""with {OWN_SQL}, d as (select scene_id, y, x, count(distinct owner) as depth, arg_max(owner, ord) as won from lay group by all),
tot as (select scene_id, count(*) as assigned, count(*) filter (depth>1) as over, count(*) filter (won='terrain:grass') as terrain_visible_pixels from d group by 1),
c as (select scene_id, count(*) as instances, count(*) filter (confidence<=0.3) as qa_failed_instances, bool_and(confidence>0.3) filter (category='grass_ground') as ground_ok from fx_shapes group by 1)
select c.scene_id, instances, qa_failed_instances, terrain_visible_pixels, round(instances/({W * H}/1e6)::double,6) as detection_density, (not ground_ok)::int::bigint as terrain_qa_failed_layers,
  concat_ws(',', case when ({W * (H - 10)}-assigned)/{W * (H - 10)}::double>0.01 then 'UNASSIGNED_REGION' end, case when over/{W * (H - 10)}::double>0.01 then 'PIXEL_CONFLICT' end) as failure_types, 'manual_review' as status from c join tot using (scene_id)""", "fx_runs"))
def summary(spark: SparkSession, folder: str) -> DataFrame:
    owned, stacked, painted = _owned(spark, folder)
    none = scenes(spark, folder).select("scene_id", F.lit("x").alias("failure_type"), F.lit("x").alias("action")).limit(0)
    out = R.scene_summary(scenes(spark, folder), painted, O.ownership_summary(owned, eligible(spark, folder)), O.terrain_layers(painted, owned, stacked), none, none)
    return tidy(out.select("scene_id", "instances", "qa_failed_instances", "terrain_visible_pixels", "detection_density", "terrain_qa_failed_layers", F.concat_ws(",", "failure_types").alias("failure_types"), "status"))


@query("component_summary", with_views("""with i as (select det_id, y, x0, x1 from fx_runs) select det_id, 1::bigint as components, sum(x1-x0)::bigint as largest, 0::bigint as small_regions from i group by 1""", "fx_runs"))
def component_summary(spark: SparkSession, folder: str) -> DataFrame:
    whole = mask_runs(shapes(spark, folder), ["scene_id", "det_id"])
    parts = M.mask_components(whole.select("scene_id", "det_id", "y", "x0", "x1"), ["scene_id", "det_id"])
    return tidy(M.component_summary(parts, ["scene_id", "det_id"]).drop("scene_id"))


@query("monitored_rounds", with_views("""with g as (select *, coverage - coalesce(lag(coverage) over (partition by scene_id order by round), 0) as gain from fx_rounds),
s as (select *, new_accepted=0 or gain<0.002 as stalled from g), k as (select *, sum(case when stalled then 0 else 1 end) over (partition by scene_id order by round) as grp from s),
f as (select *, sum(case when stalled then 1 else 0 end) over (partition by scene_id, grp order by round) as no_progress from k)
select scene_id, round, round(coverage,6) as coverage, round(gain,6) as gain, no_progress::bigint as no_progress, case when round>=8 then 'max_rounds' when no_progress>=2 then 'no_progress' when coverage<0.85 then '' else 'reviewer_stop' end as stop_reason, coverage<0.85 and round<8 and no_progress<2 as continue_detection from f""", "fx_rounds"))
def monitored(spark: SparkSession, folder: str) -> DataFrame:
    """The rounds read as a stream of files, with the state kept per scene."""
    rounds = materialize(view(spark, folder, "fx_rounds"))
    source = os.path.dirname(rounds.inputFiles()[0])
    target = f"{scratch_folder(spark).rstrip('/')}/monitor-{os.path.basename(source)}"
    stream = monitor_rounds(spark.readStream.schema(rounds.schema).parquet(source), max_rounds=8)
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", target + "-state").trigger(availableNow=True).start().awaitTermination()
    return tidy(spark.read.schema(stream.schema).parquet(target))


@query("scored_requests", f"""with {REQUESTS_SQL} select seq, case when mod(seq,13)=0 then 'failed' else 'ok' end as status, case when mod(seq,13)=0 then 'ValueError: bad window' end as error, case when mod(seq,13)=0 then 0 else mod(seq,3) end as candidates from req""")
def scored(spark: SparkSession, folder: str) -> DataFrame:
    def score(row: dict) -> list[dict]:
        if row["seq"] % 13 == 0:
            raise ValueError("bad window")
        return [{"category": "tree", "confidence": 0.5 + i / 10} for i in range(int(row["seq"]) % 3)]
    plan = table(spark, folder, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("scene_id"))
    out = run_scorer(plan, score, T.StructType([T.StructField("category", T.StringType()), T.StructField("confidence", T.DoubleType())]))
    return tidy(out.select("seq", "status", "error", F.size("found").alias("candidates")))


@query("manifest_roundtrip", with_views("""select scene_id, count(*) filter (category<>'flower') as objects, count(*) filter (category='flower') as effects, sum(x)::bigint as x, min('objects/' || det_id || '.png') as first_asset from fx_boxes group by 1""", "fx_boxes"))
def roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Writes the manifests of all scenes, with gaps in ``seq``, reads them back and upgrades them."""
    import uuid
    box = F.struct(*(F.col(c).cast("bigint").alias(c) for c in "xywh"))
    b = view(spark, folder, "fx_boxes")
    objects = b.select("scene_id", (F.col("seq") * 1000).alias("seq"), F.col("det_id").cast("string").alias("id"), "category", F.when(F.col("category") == "flower", "fx_environment").otherwise("prop").alias("group"), "confidence", box.alias("bbox"),
                       F.lit("pass").alias("status"), F.concat(F.lit("/out/objects/"), F.col("det_id").cast("string"), F.lit(".png")).alias("asset_path"))
    frame = view(spark, folder, "fx_scenes").withColumn("projection", F.lit("unknown"))
    path = f"{scratch_folder(spark).rstrip('/')}/manifests-{uuid.uuid4().hex}"
    A.write_manifests(frame, objects, path, "/out")
    _, rows = A.read_manifest_rows(spark, path)
    every = A.upgrade_rows(rows).select("scene_id", "kind", "object.*")
    return tidy(every.groupBy(F.col("scene_id").cast("bigint").alias("scene_id")).agg(F.count_if(F.col("kind") == "objects").alias("objects"), F.count_if(F.col("kind") == "environment_effects").alias("effects"), F.sum("geometry.visible_bbox.x").alias("x"), F.min("asset_path").alias("first_asset")))


def _values(rows: list[tuple]) -> str:
    """SQL rows of fixed values."""
    text = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ",".join("(" + ",".join(map(text, row)) + ")" for row in rows)


_LAYERS = [(i, group, name) for i, group in enumerate(taxonomy.MEMBERS) for name in taxonomy.layer_members(group)]
_GROUPS = [(name, group) for group, names in taxonomy.GROUP_MEMBERS.items() for name in names]
_PROMPTS = [(i, group, name) for i, (group, names) in enumerate(taxonomy.PROMPT_GROUPS.items()) for name in names]


@query("boxes_by_dimension", with_views(f"""with g as (select * from (values {_values(_GROUPS)}) t(category, grp)), l as (select * from (values {_values(_LAYERS)}) t(layer_order, layer, category)),
p as (select category, count(*) as prompts, min(group_order) as first_prompt from (values {_values(_PROMPTS)}) t(group_order, prompt_group, category) group by 1),
s as (select * from (values {_values(list(taxonomy.SOLID_TERRAIN.items()))}) t(category, terrain_class))
select scene_id, category, grp, layer_order::bigint as layer_order, layer, terrain_class, coalesce(prompts, 0) as prompts, first_prompt::bigint as first_prompt, count(*) as boxes from fx_boxes left join g using (category) left join l using (category) left join p using (category) left join s using (category) group by all""", "fx_boxes"))
def boxes_by_dimension(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes by the dimension tables of the taxonomy, which are joined like any other."""
    d = taxonomy.dims(spark)
    prompts = d["dim_prompt_group"].groupBy("category").agg(F.count(F.lit(1)).alias("prompts"), F.min("group_order").alias("first_prompt"))
    out = view(spark, folder, "fx_boxes").select("scene_id", "category")
    for side in (d["dim_category"], d["dim_layer"], prompts, d["dim_terrain"]):
        out = out.join(side, "category", "left")
    keys = ["scene_id", "category", "grp", "layer_order", "layer", "terrain_class", F.coalesce("prompts", F.lit(0)).alias("prompts"), "first_prompt"]
    return tidy(out.groupBy(*keys).agg(F.count(F.lit(1)).alias("boxes")))


@query("tables_roundtrip", with_views("""select 'boxes' as name, scene_id, count(*) as n, sum(x + y + w + h)::bigint as total from fx_boxes group by 2
union all select 'truth', scene_id, count(*), sum(x + y + w + h)::bigint from fx_gt group by 2""", "fx_boxes", "fx_gt"))
def tables_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Tables written side by side and read again."""
    where = f"{scratch_folder(spark).rstrip('/')}/tables-{os.urandom(8).hex()}"
    A.write_tables({"boxes": view(spark, folder, "fx_boxes"), "truth": view(spark, folder, "fx_gt")}, where)
    read = lambda name: spark.read.parquet(f"{where}/{name}").groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x") + F.col("y") + F.col("w") + F.col("h")).alias("total")).withColumn("name", F.lit(name))
    return tidy(read("boxes").unionByName(read("truth")).select("name", "scene_id", "n", "total"))


@query("scene_objects", with_views("""select scene_id, category, (x//256)::bigint as place, count(*) > 1 as merged, count(*)::bigint as sources, min(det_id) as first_source, max(det_id) as last_source
from fx_detections group by 1, 2, 3""", "fx_detections"))
def scene_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates with the observations that support them, as scene objects."""
    seen = view(spark, folder, "fx_detections").withColumn("place", F.floor(F.col("x") / 256))
    rows = seen.groupBy("scene_id", "category", "place").agg(F.collect_list(F.struct(F.col("det_id").alias("id"), "confidence")).alias("observations"))
    out = D.to_objects(rows).withColumn("ids", F.array_sort("source_candidates"))
    return tidy(out.select("scene_id", "category", "place", "merged", F.size("ids").alias("sources"), F.get("ids", F.lit(0)).alias("first_source"), F.element_at("ids", -1).alias("last_source")))
