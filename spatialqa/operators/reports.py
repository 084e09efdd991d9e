"""Counters and summaries of detection rounds, runs and scenes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spatialqa.functions.boxes import Box
from spatialqa.operators.runs import ROW, on_strips, pixel_count, rect_runs, run_difference, shared_pieces, union_runs
from spatialqa.session import unfolded

COUNTERS = ["global_candidates", "tile_candidates", "redetection_candidates", "combined_candidates", "after_dedup", "after_filter"]

#: Runs of boxes in a partition.
UNFOLDED_RUNS = 500_000


def scan_depth(scenes: DataFrame, scans: DataFrame, tiles: DataFrame, candidates: DataFrame) -> DataFrame:
    """Unscanned pixels, scanned pixels without a candidate, deepest tile overlap per scene.

    Boxes become row runs; distinct windows first, so repeated scans cost nothing. Runs are spread over as
    many partitions as their number is worth: by their packed bytes, a few tasks would get millions of them.
    """
    box = ["scene_id", *"xywh"]
    def lines(df: DataFrame, once: bool) -> DataFrame:
        runs = df.agg(F.sum(F.greatest(F.col("h"), F.lit(0))).cast("bigint")).first()[0] or 0
        parts = max(1, -(-runs // UNFOLDED_RUNS))
        framed = df.select(*box).join(scenes.select("scene_id", "width", "height"), "scene_id").repartitionByRange(parts, *box)
        return unfolded(rect_runs(framed.distinct() if once else framed).select(*ROW, "x0", "x1").repartition(parts, *ROW))
    seen = union_runs(lines(scans.filter(F.col("status") == "ok"), True))
    bare = run_difference(seen, lines(candidates, True))
    area = scenes.select("scene_id", (F.col("width").cast("bigint") * F.col("height")).alias("_area"))
    # Depth by a sweep over run ends: +1 at a start, -1 at an end. Tiles are not deduplicated.
    rows = on_strips(lines(tiles, False))
    keys = [*ROW, "_s"]
    marks = rows.select(*keys, F.col("x0").alias("c"), F.lit(1).alias("d")).unionAll(rows.select(*keys, F.col("x1").alias("c"), F.lit(-1).alias("d")))
    net = marks.groupBy(*keys, "c").agg(F.sum("d").alias("d"))
    depth = net.withColumn("_depth", F.sum("d").over(Window.partitionBy(*keys).orderBy("c"))).groupBy("scene_id").agg(F.max("_depth").cast("bigint").alias("max_tile_overlap"))
    out = area
    for part in (pixel_count(seen, ["scene_id"], "_seen"), pixel_count(bare, ["scene_id"], "scanned_without_candidates"), depth):
        out = out.join(part, "scene_id", "left")
    out = out.fillna(0, ["_seen", "scanned_without_candidates", "max_tile_overlap"])
    return out.select("scene_id", (F.col("_area") - F.col("_seen")).alias("unscanned_pixels"), "scanned_without_candidates", "max_tile_overlap")


def detection_summary(runs: DataFrame, selected: DataFrame, rejected: DataFrame, scans: DataFrame, keys: list[str] = ["scene_id"]) -> DataFrame:
    """Counters summed over rounds, category and reason counts, failed tiles, final objects.

    ``runs(scene_id, round, <counters>, tile_count)``; maps hold one entry per category or reason.
    """
    have = [c for c in [*COUNTERS, "tile_count"] if c in runs.columns]
    out = runs.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in have), F.count(F.lit(1)).alias("rounds"))
    tally = lambda df, c, name: (df.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("n")).groupBy(*keys)
                                 .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(name)))
    failed = scans.filter((F.col("status") == "failed") & (F.col("source") == "tile")).select(*keys, "round", "tile_id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("failed_tiles"))
    final = selected.groupBy(*keys).agg(F.count(F.lit(1)).alias("final_objects"))
    for part in (tally(selected, "category", "category_counts"), tally(rejected, "reason", "rejection_reasons"), failed, final):
        out = out.join(part, keys, "left")
    return out.fillna(0, ["failed_tiles", "final_objects"])


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def span_report(spans: DataFrame, *, loads: tuple[str, ...] = ("load",), inference: tuple[str, ...] = ("inference",),
                post: tuple[str, ...] = ("postprocess",)) -> DataFrame:
    """Time per model by kind, exclusive where known: ``model, load_time, inference_time, postprocess_time, peak``."""
    time = F.coalesce("exclusive_duration", "duration") if "exclusive_duration" in spans.columns else F.col("duration")
    part = lambda kinds: F.sum(F.when(F.col("kind").isin(*kinds), time).otherwise(0.0))
    peak = F.max("vram_peak") if "vram_peak" in spans.columns else F.lit(None).cast("double")
    return spans.filter(F.col("model").isNotNull()).groupBy("model").agg(
        part(loads).alias("load_time"), part(inference).alias("inference_time"), part(post).alias("postprocess_time"),
        F.count(F.lit(1)).alias("spans"), peak.alias("peak"))


def instance_report(spans: DataFrame) -> DataFrame:
    """Spans, time and retries per instance."""
    retry = F.col("retry_count") > 0
    return spans.filter(F.col("instance_id").isNotNull()).groupBy("instance_id").agg(
        F.count(F.lit(1)).alias("spans"), F.sum("duration").alias("total_time"), F.count_if(retry).alias("retry_calls"),
        F.sum(F.when(retry, F.col("duration")).otherwise(0.0)).alias("retry_time"))


def run_totals(spans: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """Retry share and, with ``cache(namespace, hit, miss)``, the cache hit rate; one row."""
    retry = F.col("retry_count") > 0
    out = spans.agg(F.sum("duration").alias("total_time"), F.count_if(retry).alias("retry_calls"),
                    F.sum(F.when(retry, F.col("duration")).otherwise(0.0)).alias("retry_time"))
    out = out.withColumn("retry_fraction", F.coalesce(F.try_divide("retry_time", "total_time"), F.lit(0.0)))
    if cache is None:
        return out
    rate = cache.agg(F.sum("hit").alias("cache_hits"), F.sum(F.col("hit") + F.col("miss")).alias("_calls"))
    rate = rate.withColumn("cache_hit_rate", F.coalesce(F.try_divide("cache_hits", "_calls"), F.lit(0.0))).drop("_calls")
    # Two single-row totals side by side.
    return out.withColumn("_one", F.lit(1)).join(rate.withColumn("_one", F.lit(1)), "_one").drop("_one")


def node_list(spans: DataFrame) -> DataFrame:
    """Distinct workflow steps with their number of visits and time."""
    return spans.filter(F.col("kind") == "node").groupBy("name").agg(F.count(F.lit(1)).alias("visits"), F.sum("duration").alias("time"))


def scene_summary(scenes: DataFrame, objects: DataFrame, ownership: DataFrame, terrain: DataFrame, regions: DataFrame, attempts: DataFrame,
                  *, max_unassigned: float = 0.01, max_overlap: float = 0.01) -> DataFrame:
    """Counts, ratios, density, failure types and status per scene.

    ``objects(scene_id, element_type, status, uncertain)``; ``ownership`` from
    ``ownership_summary``; ``terrain`` from ``terrain_layers``; ``regions(scene_id,
    failure_type)`` open problem regions; ``attempts(scene_id, action)``.
    """
    effect = F.col("element_type") == "effect"
    counts = objects.groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("_objects"), F.count_if(~effect).alias("instances"), F.count_if(effect).alias("effects"),
        F.count_if(~effect & (F.col("status") != "pass")).alias("qa_failed_instances"), F.count_if(F.col("uncertain")).alias("uncertain_categories"))
    ground = terrain.groupBy("scene_id").agg(F.count(F.lit(1)).alias("terrain_layers"), F.sum("visible_pixels").alias("terrain_visible_pixels"),
                                             F.count_if(F.col("qa_status") == "manual_review").alias("terrain_qa_failed_layers"))
    kinds = regions.groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("remaining_problem_regions"), F.count_if(F.coalesce("failure_type", F.lit("MISSED_DETECTION")) == "MISSED_DETECTION").alias("remaining_missed_candidates"),
        F.array_sort(F.collect_set(F.coalesce("failure_type", F.lit("MISSED_DETECTION")))).alias("_kinds"))
    review = attempts.groupBy("scene_id").agg(F.max(F.col("action") == "vision_review_failed").alias("vision_review_failed"))
    out = scenes.select("scene_id", "width", "height").join(ownership, "scene_id", "left")
    for part in (counts, ground, kinds, review):
        out = out.join(part, "scene_id", "left")
    numbers = ["_objects", "instances", "effects", "qa_failed_instances", "uncertain_categories", "terrain_layers", "terrain_visible_pixels",
               "terrain_qa_failed_layers", "remaining_problem_regions", "remaining_missed_candidates"]
    out = out.fillna(0, numbers).fillna(False, ["vision_review_failed"])
    types = F.array_distinct(F.concat(
        F.array_compact(F.array(F.when(F.col("unassigned_ratio") > max_unassigned, "UNASSIGNED_REGION"), F.when(F.col("overlap_ratio") > max_overlap, "PIXEL_CONFLICT"))),
        F.coalesce("_kinds", F.array().cast("array<string>"))))
    out = out.withColumn("failure_types", types).withColumn("detection_density", F.col("_objects") / (F.col("width") * F.col("height") / 1e6))
    bad = ((F.size("failure_types") > 0) | (F.col("qa_failed_instances") > 0) | (F.col("terrain_qa_failed_layers") > 0)
           | F.col("vision_review_failed") | (F.col("uncertain_categories") > 0))
    return out.withColumn("status", F.when(bad, "manual_review").otherwise("pass")).drop("_objects", "_kinds")


def retry_counts(attempts: DataFrame, keys: list[str] = ["scene_id"]) -> DataFrame:
    """Retries per scene and lower-cased reason."""
    return attempts.groupBy(*keys, F.lower(F.coalesce("retry_reason", F.lit("UNKNOWN"))).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
