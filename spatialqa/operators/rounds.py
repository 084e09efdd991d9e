"""Progress over detection rounds and best versions of objects."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spatialqa.operators.ordered import first_per, order_ranges, running
from spatialqa.session import materialize

MIN_GAIN, PATIENCE, MAX_ROUNDS, MAX_OBJECTS, TARGET = 0.002, 2, 3, 300, 0.85


def round_progress(rounds: DataFrame, min_gain: float = MIN_GAIN, keys: list[str] = ["scene_id"]) -> DataFrame:
    """Adds ``gain, stalled, no_progress`` (length of the current stall) and, with ``retries``, their running total.

    ``rounds(scene_id, round, coverage, new_accepted)``. The previous coverage and the last
    round that made progress are running maxima, so a long history is spread over the ranges of a scan.
    """
    last, ends = F.struct("round", "coverage"), order_ranges(rounds, "round")
    seen = running(rounds, keys, "round", {"_last": ("max", last), "_nth": ("count", F.lit(1))}, exclusive=["_last"], ends=ends)
    gain = F.col("coverage") - F.coalesce(F.col("_last.coverage"), F.lit(0.0))
    seen = seen.withColumn("gain", gain).withColumn("stalled", (F.col("new_accepted") == 0) | (F.col("gain") < min_gain)).drop("_last")
    extra = {"total_retries": ("sum", F.col("retries"))} if "retries" in rounds.columns else {}
    out = running(seen, keys, "round", {"_moved": ("max", F.when(~F.col("stalled"), F.col("_nth"))), **extra}, ends=ends)
    return out.withColumn("no_progress", (F.col("_nth") - F.coalesce("_moved", F.lit(0))).cast("bigint")).drop("_nth", "_moved")


def stop_reason(round_: Column, objects: Column, no_progress: Column, max_rounds: int = MAX_ROUNDS, max_objects: int | None = MAX_OBJECTS,
                patience: int = PATIENCE) -> Column:
    """First limit reached, empty when none is."""
    crowded = F.lit(False) if max_objects is None else objects >= max_objects
    return F.when(round_ >= max_rounds, "max_rounds").when(crowded, "max_objects").when(no_progress >= patience, "no_progress").otherwise("")


def wants_more(coverage: Column, target: float = TARGET) -> Column:
    """Rule reviewer: go on until the target coverage."""
    return coverage < target


def decide_rounds(progress: DataFrame, objects: Column | None = None, **limits) -> DataFrame:
    """Adds ``stop_reason`` and ``continue_detection`` to round progress."""
    count = F.lit(0) if objects is None else objects
    reason = stop_reason(F.col("round"), count, F.col("no_progress"), **limits)
    more = wants_more(F.col("coverage")) & (reason == "")
    return (progress.withColumn("continue_detection", more)
            .withColumn("stop_reason", F.when(reason != "", reason).when(more, "").otherwise("reviewer_stop")))


def route_after_qa(retryable: Column, retries: Column, maximum: Column | int) -> Column:
    """``retry`` while something can be retried and attempts remain."""
    limit = F.lit(maximum) if isinstance(maximum, int) else maximum
    return F.when((retryable > 0) & (retries < limit), "retry").otherwise("continue")


def merge_archive(versions: DataFrame, keys: list[str] = ["scene_id", "object_id"]) -> DataFrame:
    """The version each object ends with after all rounds.

    ``versions(..., round, status, usable, confidence)``. A passed version is final, so the
    first passed round wins; without one the best (usable, confidence), latest on a tie.
    """
    passed = F.col("status") == "pass"
    order = [F.when(passed, 0).otherwise(1), F.when(passed, F.col("round")), -F.col("usable").cast("int"), -F.col("confidence"), -F.col("round")]
    return first_per(versions, keys, order)


def pick_masks(windows: DataFrame, keys: list[str] = ["scene_id", "object_id"]) -> tuple[DataFrame, DataFrame]:
    """(best mask of each window, mean best score per object); first candidate on a tie."""
    best = first_per(windows, [*keys, "window_no"], [-F.col("score"), F.col("candidate_no")])
    return best, best.groupBy(*keys).agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("windows"))


def accept_retries(attempts: DataFrame, keys: list[str] = ["scene_id", "object_id"]) -> DataFrame:
    """Marks the attempts that replace what came before.

    ``attempts(..., attempt, score, failures, usable)``; the first attempt is the original. A
    retry is accepted when usable, scoring more than 1e-6 above the current version and
    failing no more. Each round finds the next accepted attempt of every object still
    improving, by a partial aggregate; objects drop out as soon as none follows.
    """
    c = F.col
    state = first_per(attempts.select(*keys, "attempt", "score", "failures"), keys, [c("attempt")])
    accepted = attempts.select(*keys, "attempt").limit(0)
    while True:
        now = state.select(*keys, c("attempt").alias("_at"), c("score").alias("_score"), c("failures").alias("_failures"))
        better = (c("attempt") > c("_at")) & c("usable") & (c("score") > c("_score") + 1e-6) & (c("failures") <= c("_failures"))
        following = attempts.join(now, keys).filter(better).select(*keys, "attempt", "score", "failures")
        state = materialize(first_per(following, keys, [c("attempt")]))
        if state.isEmpty():
            break
        accepted = accepted.unionByName(state.select(*keys, "attempt"))
    return (attempts.join(accepted.withColumn("improved", F.lit(True)), [*keys, "attempt"], "left")
            .withColumn("improved", F.coalesce("improved", F.lit(False))).select(*attempts.columns, "improved"))


def round_threshold(round_: Column, normal: float, relaxed: float, relax_from: int = 3, floor: float | None = None) -> Column:
    """Detection threshold of a round: the lower one from ``relax_from`` on, at most ``floor`` when given."""
    value = F.when(round_ >= relax_from, F.least(F.lit(normal), F.lit(relaxed))).otherwise(F.lit(normal))
    return value if floor is None else F.least(value, F.lit(floor))
