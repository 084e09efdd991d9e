"""Regression gate between a baseline and a current evaluation of the same scenes."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Metric, allowed worsening, whether higher is worse, whether the change is relative.
METRICS = [("recall", 0.02, False, False), ("precision", 0.03, False, False), ("duplicate_rate", 0.02, True, False),
           ("runtime", 0.20, True, True), ("boundary_fscore", 0.0, False, False)]
COMPARABLE = ["annotation_digest", "image_digest", "inventory_kind", "config"]


def regression_gate(baseline: DataFrame, current: DataFrame, limits: dict[str, float] | None = None, scene: str = "scene_id") -> DataFrame:
    """One row per scene and check: ``check, baseline, current, delta, status``.

    Reports carry the metrics, the comparability columns and ``truncated, mock,
    annotation_status, budget_exhausted, resource_failures``.
    """
    limits = limits or {}
    columns = [*(m[0] for m in METRICS), *COMPARABLE, "truncated", "mock", "annotation_status", "budget_exhausted", "resource_failures"]
    side = lambda df, s: df.select(scene, F.lit(True).alias(f"in_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in columns))
    both = side(baseline, "b").join(side(current, "c"), scene, "full_outer")
    empty = F.lit(None).cast("double")

    def metric(name: str, limit: float, higher_bad: bool, relative: bool) -> Column:
        old, new = F.col(f"{name}_b"), F.col(f"{name}_c")
        delta = (new - old) / F.greatest(old, F.lit(1e-9)) if relative else new - old
        worse = delta if higher_bad else -delta
        status = F.when(old.isNull() | new.isNull(), "WARN").when(worse > limits.get(name, limit), "FAIL").otherwise("PASS")
        return F.struct(F.lit(name).alias("check"), old.cast("double").alias("baseline"), new.cast("double").alias("current"),
                        delta.cast("double").alias("delta"), status.alias("status"))

    def flag(name: str, hit: Column, status: str) -> Column:
        return F.when(F.coalesce(hit, F.lit(False)), F.struct(F.lit(name).alias("check"), empty.alias("baseline"), empty.alias("current"),
                                                             empty.alias("delta"), F.lit(status).alias("status")))

    any_of = lambda f: f("b") | f("c")
    differs = reduce(lambda a, b: a | b, (~F.col(f"{c}_b").eqNullSafe(F.col(f"{c}_c")) for c in COMPARABLE)) | F.col("in_b").isNull() | F.col("in_c").isNull()
    doubtful = any_of(lambda s: ~F.col(f"truncated_{s}").eqNullSafe(F.lit(False)) | F.coalesce(F.col(f"mock_{s}"), F.lit(False))
                      | ~F.col(f"annotation_status_{s}").eqNullSafe(F.lit("reviewed")))
    checks = [metric(*m) for m in METRICS] + [
        flag("comparability", differs, "FAIL"), flag("validity", doubtful, "WARN"),
        flag("scan_budget", any_of(lambda s: F.coalesce(F.col(f"budget_exhausted_{s}"), F.lit(False))), "WARN"),
        flag("execution", any_of(lambda s: F.coalesce(F.col(f"resource_failures_{s}"), F.lit(0)) > 0), "FAIL")]
    return both.select(scene, F.inline(F.array_compact(F.array(*checks))))


def gate_status(checks: DataFrame, scene: str = "scene_id") -> DataFrame:
    """Worst status per scene: FAIL over WARN over PASS."""
    level = F.max(F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0))
    return checks.groupBy(scene).agg(level.alias("_l")).select(scene, F.get(F.array(*map(F.lit, ("PASS", "WARN", "FAIL"))), F.col("_l")).alias("status"))


def first_run_status(report: DataFrame, scene: str = "scene_id") -> DataFrame:
    """Without a baseline a run fails only when resource recovery cut it short."""
    return report.select(scene, F.when(F.coalesce("resource_failures", F.lit(0)) > 0, "FAIL").alias("status"))
