"""Analytic inputs derived from the driver's parquet tables, in text both engines run.

Each view is integer or dyadic-safe arithmetic over one table, so its rows grow with
that table: 400 boxes per scene, and more scenes with more events.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spatialqa.operators.runs import BAND, STRIP, box_tiles
from spatialqa.session import dealt, dealt_whole, unfolded

WIDTH, HEIGHT = 1800, 1200

VIEWS: dict[str, str] = {
    "fx_boxes": """
select event_id as det_id, event_id as seq,
  cast(floor(event_id/400) as bigint) as scene_id,
  case event_type when 'view' then 'tree' when 'signup' then 'stone_lantern' when 'click' then 'grass_ground'
       when 'error' then 'building' else 'flower' end as category,
  mod(event_id*7919,997)/cast(997 as double) as confidence,
  8+mod((cast(floor(event_id/100) as bigint)*4+mod(event_id,4))*104729,1543)+mod(event_id*13,17)-8 as x,
  8+mod((cast(floor(event_id/100) as bigint)*4+mod(event_id,4))*7907,1021)+mod(event_id*29,13)-6 as y,
  40+mod((cast(floor(event_id/100) as bigint)*4+mod(event_id,4))*31,157)+mod(event_id,7) as w,
  30+mod((cast(floor(event_id/100) as bigint)*4+mod(event_id,4))*17,139)+mod(event_id,5) as h
from events""",
    # Sides from 10 to 10^6; scene 0 holds a third of all rows and one of the largest boxes.
    "fx_mixed": """
select det_id, det_id as seq, scene_id, category, confidence, x, y,
  case when kind = 'huge' then 1000000 when kind = 'large' then 20000+mod(det_id*31,30000) when kind = 'middle' then 300+mod(det_id*31,700) else 10+mod(det_id,41) end as w,
  case when kind = 'huge' then 1000000 when kind = 'large' then 20000+mod(det_id*17,30000) when kind = 'middle' then 300+mod(det_id*17,700) else 10+mod(det_id,37) end as h
from (select event_id as det_id, case when mod(event_id,3)=0 then 0 else 1+cast(floor(event_id/400) as bigint) end as scene_id,
  case event_type when 'view' then 'tree' when 'signup' then 'stone_lantern' when 'click' then 'grass_ground' when 'error' then 'building' else 'flower' end as category,
  mod(event_id*7919,997)/cast(997 as double) as confidence,
  mod(cast(floor(event_id/60) as bigint)*7919,99991)+mod(event_id*13,11) as x, mod(cast(floor(event_id/60) as bigint)*104729,99991)+mod(event_id*29,7) as y,
  case when event_id = 3 or (mod(event_id,3)<>0 and mod(event_id,1999)=11) then 'huge' when mod(event_id,3)<>0 and mod(event_id,499)=7 then 'large'
       when mod(event_id,97)=5 then 'middle' else 'small' end as kind
  from events) t""",
    "fx_scenes": """
select distinct cast(floor(event_id/400) as bigint) as scene_id, 1800 as width, 1200 as height from events""",
    # The same boxes at a quarter of the size, for mask work: scenes of 450 x 300.
    "fx_shapes": """
select det_id, seq, scene_id, category, confidence, cast(floor(x/4) as bigint) as x, cast(floor(y/4) as bigint) as y,
  cast(floor(w/4) as bigint) as w, cast(floor(h/4) as bigint) as h from fx_boxes""",
    "fx_windowed": """
select *, case when mod(det_id,3)=0 then 'global' else 'tile' end as source,
  case when mod(det_id,3)=0 then 0 when x>=1536 then 1288 else cast(floor(x/384) as bigint)*384 end as wx0,
  case when mod(det_id,3)=0 then 0 when y>=768 then 688 else cast(floor(y/384) as bigint)*384 end as wy0
from fx_boxes""",
    "fx_detections": """
select det_id, seq, scene_id, category, confidence, source, wx0, wy0, wx1, wy1,
  x, y, least(x+w,wx1)-x as w, least(y+h,wy1)-y as h from (
  select *, case when source='global' then 1800 else wx0+512 end as wx1,
            case when source='global' then 1200 else wy0+512 end as wy1 from fx_windowed) t""",
    "fx_gt": """
select det_id as gt_id, scene_id, category, x+2 as x, y-1 as y, w, h from fx_boxes where mod(det_id,20)=7""",
    "fx_candidates": """
select l_orderkey as instance_id,
  row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_extendedprice) as seq,
  case mod(l_partkey,4) when 0 then 'segmentation' when 1 then 'inpaint' when 2 then 'generation' else 'crop_mask' end as type,
  case l_returnflag when 'A' then 'ACCEPT' when 'N' then 'RETRY' else 'REJECT' end as status,
  cast(round(l_discount*100) as int)/cast(10 as double) as overall, mod(l_suppkey,3) as attempt from lineitem""",
    "fx_rounds": """
select scene_id, round, mod(o_orderkey,4) as new_accepted,
  sum(mod(o_orderkey,7)) over (partition by scene_id order by round)/cast(1000 as double) as coverage from (
  select o_orderkey, cast(floor(o_custkey/5) as bigint) as scene_id,
         row_number() over (partition by cast(floor(o_custkey/5) as bigint) order by o_orderdate,o_orderkey) as round from orders) t""",
    "fx_spans": """
select event_id as span_id, event_type as name,
  case mod(event_id,5) when 0 then 'load' when 1 then 'inference' when 2 then 'postprocess' when 3 then 'node' else 'cache' end as kind,
  mod(user_id,4) as model, user_id as instance_id, value/cast(100 as double) as duration,
  case when mod(event_id,4)=0 then 1 else 0 end as retry_count from events""",
}

NEEDS = {"fx_shapes": ["fx_boxes"], "fx_runs": ["fx_shapes"], "fx_windowed": ["fx_boxes"], "fx_detections": ["fx_windowed"], "fx_gt": ["fx_boxes"]}


# DuckDB text of the diamond mask of every shape (``mask_runs`` is the Spark form).
VIEWS["fx_runs"] = """
select det_id, scene_id, category, y+dy as y, x+ins as x0, x+w-ins as x1 from (
  select *, (abs(2*dy+1-h)*w)//(4*h) as ins from (select *, unnest(range(h)) as dy from fx_shapes)) where x+w-ins > x+ins"""


def with_views(body: str, *names: str) -> str:
    """``body`` behind the common table expressions of the named views and what they need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for parent in NEEDS.get(name, []):
            visit(parent)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    ctes = [f"{name} as ({VIEWS[name]})" for name in ordered]
    head, rest = body.lstrip(), ""
    lower = head.lower()
    if lower.startswith("with recursive"):
        rest = "recursive "
        head = "," + head[len("with recursive"):]
    elif lower.startswith("with "):
        head = "," + head[len("with"):]
    return f"with {rest}" + ",\n".join(ctes) + "\n" + head


def mask_runs(shapes: DataFrame, whole: list[str] | None = None) -> DataFrame:
    """Diamond mask of every shape as runs, with the other columns of the shape; all runs of one ``whole`` (its id, say) in one task."""
    dy, w, h = F.col("_dy"), F.col("w"), F.col("h")
    inset = F.expr("abs(2*_dy+1-h)*w div (4*h)")
    rows = (dealt_whole(shapes, whole) if whole else dealt(shapes, ["scene_id", "y", "det_id"])).withColumn("_dy", F.explode(F.sequence(F.lit(0).cast("bigint"), h - 1))).withColumn("_in", inset)
    rest = [c for c in shapes.columns if c not in ("x", "y", "w", "h")]
    return unfolded(rows.select(*rest, (F.col("y") + dy).alias("y"), (F.col("x") + F.col("_in")).alias("x0"), (F.col("x") + w - F.col("_in")).alias("x1")).filter("x1 > x0"))


def tile_runs(shapes: DataFrame, rows: int | None = None) -> DataFrame:
    """The runs of ``mask_runs`` cut at tiles, in tasks that hold whole tiles; ``rows`` is the number of shapes, counted if not given."""
    w, h, band, s = F.col("w"), F.col("h"), F.lit(BAND), F.lit(STRIP)
    boxes = box_tiles(shapes, shapes.count() if rows is None else rows)
    low, high = F.greatest("y", F.col("_band") * band), F.least(F.col("y") + h, (F.col("_band") + 1) * band)
    cut = boxes.withColumn("_row", F.explode(F.sequence(low, high - 1))).withColumnsRenamed({"y": "_y", "_row": "y"})
    inset = cut.withColumn("_in", F.expr("abs(2*(y-_y)+1-h)*w div (4*h)"))
    rest = [c for c in shapes.columns if c not in ("x", "y", "w", "h")]
    return unfolded(inset.select(*rest, "_band", "_s", "y", F.greatest(F.col("x") + F.col("_in"), F.col("_s") * s).alias("x0"),
                                 F.least(F.col("x") + w - F.col("_in"), (F.col("_s") + 1) * s).alias("x1")).filter("x1 > x0"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A derived view as a DataFrame over the tables in ``folder``."""
    text = with_views(f"select * from {name}", name)
    for base in ("events", "lineitem", "orders"):
        if f"from {base}" in text:
            text = text.replace(f"from {base}", f"from parquet.`{folder.rstrip('/')}/{base}.parquet`")
    return spark.sql(text)
