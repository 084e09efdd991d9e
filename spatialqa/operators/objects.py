"""Quality decisions about segmented objects and the audit of their masks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spatialqa.functions.boxes import Box
from spatialqa.functions.quality import enhancement_status, instance_failures, mask_score


def diagnose_masks(stats: DataFrame) -> DataFrame:
    """Adds ``leak, quality_score, mask_ratio, failures``.

    ``stats`` is ``mask_stats`` output joined with ``confidence, edge, is_truncated,
    uncertain, element_type``.
    """
    area, one = Box.of().area, F.lit(1).cast("bigint")
    leak = (F.col("pixels") - F.col("inside")) / F.greatest(one, F.col("pixels"))
    score = mask_score(F.col("confidence"), F.col("inside"), F.col("pixels"), area, F.col("edge"), F.lit(0.0))
    cut = F.coalesce("is_truncated", F.lit(False))
    return (stats.withColumn("leak", leak).withColumn("mask_ratio", F.col("pixels") / F.greatest(one, area))
            .withColumn("quality_score", score - F.when(cut, 0.2).otherwise(0.0))
            .withColumn("failures", instance_failures(F.col("pixels"), area, leak, cut, F.coalesce("uncertain", F.lit(False)), F.col("element_type"))))


def assess_objects(objects: DataFrame, attempts: DataFrame, *, round_retries: int = 0, max_round_retries: int = 3,
                   max_attempts: int = 3, ident: list[str] = ["scene_id", "object_id"]) -> DataFrame:
    """QA status, reason, strategy and failure types of each object.

    ``objects``: ``error, asset_path, mask_path, review_required, confidence,
    classification_confidence, confidence_threshold, occupancy, outside_fraction`` and
    ``failures`` from ``diagnose_masks`` (null when not diagnosed). ``attempts(scene_id,
    object_id, action)`` is the retry log.
    """
    c = F.col
    log = attempts.groupBy(*ident).agg(
        F.count(F.lit(1)).alias("_n"), F.max(c("action") == "classification_unavailable").alias("_no_class"),
        F.max(c("action").isin("fragment_detection_unavailable", "fragment_detection_budget_exhausted")).alias("_no_frag"))
    out = objects.join(log, ident, "left")
    broken = (F.coalesce("error", F.lit("")) != "") | c("asset_path").isNull() | c("mask_path").isNull()
    unsure = F.greatest(c("confidence"), F.coalesce("classification_confidence", F.lit(0.0))) < F.coalesce("confidence_threshold", F.lit(0.35))
    rule = lambda status, reason, strategy, *types: F.struct(
        F.lit(status).alias("status"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"), F.lit(strategy).alias("strategy"),
        (F.array(*map(F.lit, types)) if types else F.array()).cast("array<string>").alias("types"))
    first = (F.when(broken, rule("retry", F.coalesce(F.when(c("error") != "", c("error")), F.lit("missing asset or mask")), "rerun_segmentation", "BAD_MASK"))
             .when(c("review_required"), rule("manual_review", "protected small object", "none"))
             .when(unsure, rule("retry", "confidence below minimum", "change_prompt", "WRONG_CATEGORY"))
             .when(F.coalesce("occupancy", F.lit(0.0)) < 0.08, rule("retry", "mask occupancy below minimum", "rerun_segmentation", "MASK_TOO_SMALL"))
             .when(c("outside_fraction") > 0.35, rule("retry", "mask leaves its detector box", "rerun_segmentation", "BACKGROUND_LEAK"))
             .otherwise(rule("pass", "confidence and mask occupancy passed", "none")))
    out = out.withColumn("_q", first)
    types = F.array_distinct(F.concat(c("_q.types"), F.coalesce("failures", F.array().cast("array<string>"))))
    out = out.withColumn("failure_types", types)
    late = (c("_q.status") == "pass") & (F.size("failure_types") > 0)
    status = F.when(late, "retry").otherwise(c("_q.status"))
    wrong, cut = F.array_contains("failure_types", "WRONG_CATEGORY"), F.array_contains("failure_types", "CROSS_TILE_FRAGMENT")
    diagnosed = c("failures").isNotNull()
    strategy = (F.when(diagnosed & ~wrong & cut, "merge_neighbor_tiles").when(late, "rerun_segmentation").otherwise(c("_q.strategy")))
    stuck = diagnosed & ((wrong & F.coalesce("_no_class", F.lit(False))) | (~wrong & cut & F.coalesce("_no_frag", F.lit(False))))
    spent = diagnosed & (F.coalesce("_n", F.lit(0)) >= max_attempts)
    over = F.lit(round_retries >= max_round_retries)
    final = (F.when(stuck, "manual_review").when((status == "retry") & (spent | over), "manual_review").otherwise(status))
    return (out.withColumn("qa_status", final).withColumn("retry_strategy", strategy)
            .withColumn("qa_reason", F.when(late, F.array_join("failure_types", ", ")).otherwise(c("_q.reason")))
            .withColumn("is_failed", c("qa_status") != "pass").drop("_q", "_n", "_no_class", "_no_frag"))


def audit_masks(objects: DataFrame, stats: DataFrame, keys: list[str] = ["scene_id", "object_id"]) -> DataFrame:
    """One outcome per object: missing, wrong size, empty or fine mask.

    ``stats(scene_id, object_id, pixels, mask_w, mask_h)``; objects carry ``width, height``.
    """
    out = objects.join(stats, keys, "left")
    c = F.col
    wrong = (c("mask_w") != c("width")) | (c("mask_h") != c("height"))
    outcome = (F.when(c("pixels").isNull(), "segmentation_failed: missing mask").when(wrong, "segmentation_failed: mask size differs")
               .when(c("pixels") == 0, "mask_too_small").otherwise("segmented"))
    return out.withColumn("outcome", outcome).withColumn("status", F.when(c("outcome") == "segmented", "segmented").otherwise("retry"))


def id_mismatches(inputs: DataFrame, outputs: DataFrame, keys: list[str] = ["scene_id", "object_id"]) -> DataFrame:
    """Ids a segmenter lost, invented or repeated; empty when it kept them all."""
    tag = lambda df, why: df.select(*keys, F.lit(why).alias("problem"))
    lost = tag(inputs.select(*keys).join(outputs, keys, "left_anti"), "missing")
    new = tag(outputs.select(*keys).join(inputs, keys, "left_anti"), "unknown")
    twice = tag(outputs.groupBy(*keys).count().filter("count > 1"), "repeated")
    return lost.unionByName(new).unionByName(twice)


def enhance_objects(objects: DataFrame, results: DataFrame, *, enabled: bool | str = True, available: bool = True, required: bool = False,
                    keys: list[str] = ["scene_id", "object_id"]) -> DataFrame:
    """Enhancement status per object; base quality is untouched, a required one that failed asks for review.

    ``results(scene_id, object_id, outcome, verdict)``; objects carry ``completion_open, asset_path``.
    """
    usable = F.lit(available or enabled != "auto")
    out = objects.join(results, keys, "left")
    status = enhancement_status(F.lit(bool(enabled)), F.col("completion_open"), F.col("asset_path").isNotNull(), usable, F.col("outcome"), F.col("verdict"))
    out = out.withColumn("enhancement_status", status)
    short = F.lit(required) & ~F.col("enhancement_status").isin("ready", "preview_only")
    return out.withColumn("status", F.when(short, "manual_review").otherwise(F.col("status"))).withColumn("needs_manual_review", short)
