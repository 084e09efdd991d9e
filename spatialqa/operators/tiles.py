"""Overlapping windows, scan batches and call budgets."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spatialqa.functions import taxonomy
from spatialqa.functions.boxes import Box, half_even
from spatialqa.operators.ordered import first_per, order_ranges, running

RETRY_SOURCES = ("redetection", "gap_fill")


def starts(length: Column, size: Column | int, overlap: float) -> Column:
    """Ascending window starts; the last one is aligned to the far edge."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.greatest(F.lit(0), length - size).cast("bigint")
    stride = F.greatest(F.lit(1).cast("bigint"), half_even(size * F.lit(1 - overlap)))
    return F.array_distinct(F.concat(F.sequence(F.lit(0).cast("bigint"), last, stride), F.array(last)))


def tiles(scenes: DataFrame, size: int = 1024, overlap: float = 0.25, *, prefix: str = "", allow_zero: bool = False) -> DataFrame:
    """Windows covering every scene: ``tile_id, row, col, x, y, w, h``."""
    if size <= 0 or not (0 <= overlap if allow_zero else 0 < overlap) or overlap >= 1:
        raise ValueError("tiles need a positive size and an overlap below 1")
    rows = scenes.select("*", F.posexplode(starts(F.col("height"), size, overlap)).alias("row", "y"))
    cells = rows.select("*", F.posexplode(starts(F.col("width"), size, overlap)).alias("col", "x"))
    number = lambda c: F.lpad(c.cast("string"), F.greatest(F.lit(2), F.length(c.cast("string"))), F.lit("0"))
    return (cells.withColumn("w", F.least(F.lit(size), F.col("width") - F.col("x")).cast("bigint"))
            .withColumn("h", F.least(F.lit(size), F.col("height") - F.col("y")).cast("bigint"))
            .withColumn("tile_id", F.concat(F.lit(f"{prefix}tile_"), number(F.col("row")), F.lit("_"), number(F.col("col")))))


def multiscale_tiles(scenes: DataFrame, size: int = 1024, scales: tuple[int, ...] = (1024, 1536), overlap: float = 0.25) -> DataFrame:
    """Tiles of several sizes; a window an earlier size already gave is dropped."""
    out = None
    for place, scale in enumerate(dict.fromkeys([size, *scales])):
        part = tiles(scenes, scale, overlap, prefix=f"s{scale}_").withColumn("scale", F.lit(scale)).withColumn("scale_pos", F.lit(place))
        out = part if out is None else out.unionByName(part)
    return first_per(out, ["scene_id", "x", "y", "w", "h"], [F.col("scale_pos")])


def category_batches(categories: DataFrame, size: int = 6) -> DataFrame:
    """Batches of categories per scene: prompt groups first, the rest by category group.

    ``categories(scene_id, category, seq)``; rows ``batch_no, batch_group, batch_index, categories``.
    A scene has at most one row per category name, so its groups stay vocabulary-sized.
    """
    once = first_per(categories, ["scene_id", "category"], [F.col("seq")])
    order = list(taxonomy.PROMPT_GROUPS)
    known = taxonomy.prompt_group(F.col("category"))
    placed = (once.withColumn("batch_group", F.coalesce(known, taxonomy.category_group(F.col("category"))))
              .withColumn("_rank", F.when(known.isNull(), len(order)).otherwise(F.array_position(F.array(*map(F.lit, order)), known) - 1)))
    group = Window.partitionBy("scene_id", "_rank", "batch_group")
    numbered = (placed.withColumn("_first", F.min("seq").over(group))
                .withColumn("batch_index", F.floor((F.row_number().over(group.orderBy("seq")) - 1) / size).cast("int")))
    batches = numbered.groupBy("scene_id", "_rank", "_first", "batch_group", "batch_index").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "category"))), lambda s: s["category"]).alias("categories"))
    place = Window.partitionBy("scene_id").orderBy("_rank", "_first", "batch_index")
    return batches.withColumn("batch_no", F.row_number().over(place) - 1).drop("_rank", "_first")


def scan_plan(requests: DataFrame, keys: list[str] = ["scene_id"], max_calls: int = 2000, max_retry: int = 100,
              used_calls: Column | None = None, used_retry: Column | None = None) -> DataFrame:
    """Admit scan requests in ``seq`` order under a total and a retry budget.

    A retry row is eligible while the retry budget lasts; an eligible row is admitted
    while the total lasts. Refused rows stay, marked ``budget_exhausted``.
    """
    spent = F.lit(0) if used_calls is None else used_calls
    spent_retry = F.lit(0) if used_retry is None else used_retry
    retry = F.col("source").isin(*RETRY_SOURCES).cast("bigint")
    ends = order_ranges(requests, "seq")
    ranked = running(requests, keys, "seq", {"_retry_rank": ("sum", retry)}, ends=ends)
    eligible = (F.col("_retry_rank") + spent_retry <= max_retry) | (retry == 0)
    counted = running(ranked.withColumn("_eligible", eligible), keys, "seq", {"_calls": ("sum", F.col("_eligible").cast("bigint"))}, ends=ends)
    admitted = F.col("_eligible") & (F.col("_calls") + spent <= max_calls)
    return counted.withColumn("status", F.when(admitted, "ok").otherwise("budget_exhausted")).drop("_retry_rank", "_eligible", "_calls")


def admit_passes(passes: DataFrame, keys: list[str] = ["scene_id"], limits: dict[str, int] | None = None) -> DataFrame:
    """Marks the passes over a whole scene that their source's limit admits, in ``seq`` order."""
    limits = {"global": 1, "tile": 2} if limits is None else limits
    ranked = running(passes, [*keys, "source"], "seq", {"_nth": ("count", F.lit(1))})
    allowed = F.lit(True)
    for source, limit in limits.items():
        allowed = allowed & ((F.col("source") != source) | (F.col("_nth") <= limit))
    return ranked.withColumn("admitted", allowed).drop("_nth")


def budget_usage(plan: DataFrame, keys: list[str] = ["scene_id"]) -> DataFrame:
    """Admitted calls per source, retry calls and refusals."""
    done = F.col("status") != "budget_exhausted"
    by = plan.groupBy(*keys, "source").agg(F.count_if(done).alias("calls"), F.count_if(~done).alias("refused"))
    return by.withColumn("is_retry", F.col("source").isin(*RETRY_SOURCES))


def scan_cost(scans: DataFrame, raw: DataFrame, kept: DataFrame) -> DataFrame:
    """Calls, runtime and yield per category group; a shared scan counts once in each of its groups.

    ``scans(scan_id, categories, status, runtime)``; ``raw``/``kept`` carry ``category``.
    The row with a null group holds the total of calls.
    """
    groups = F.array_distinct(F.transform("categories", taxonomy.category_group))
    ran = F.col("status").isin("ok", "failed")
    skipped = F.col("status") == "budget_exhausted"
    per_group = (scans.withColumn("grp", F.explode(groups)).groupBy("grp")
                 .agg(F.count_if(ran).alias("calls"), F.sum("runtime").alias("runtime"), F.count_if(skipped).alias("budget_skips")))
    tally = lambda df, name: df.groupBy(taxonomy.category_group(F.col("category")).alias("grp")).agg(F.count(F.lit(1)).alias(name))
    out = (per_group.join(tally(raw, "candidates"), "grp", "left").join(tally(kept, "retained"), "grp", "left")
           .fillna(0, ["candidates", "retained"]))
    total = scans.agg(F.lit(None).cast("string").alias("grp"), F.count_if(ran).alias("calls"), F.sum("runtime").alias("runtime"),
                      F.count_if(skipped).alias("budget_skips"))
    return out.unionByName(total, allowMissingColumns=True)


def local_windows(objects: DataFrame, maximum: int = 512, attempt: int = 0) -> DataFrame:
    """Context windows around objects; one row per window (``wx, wy, ww, wh``).

    An object larger than ``maximum`` gets the overlapping windows that touch it.
    Scene size comes from ``width`` and ``height``.
    """
    box = Box.of()
    side = F.greatest(box.w, box.h)
    ratio = F.when(side < 64, 1.0).when(side < 128, 0.6).when(side < 256, 0.3).otherwise(0.15)
    pad = half_even(side * ratio * F.lit(1 + 0.5 * attempt))
    base = objects.withColumn("_pad", pad)
    pad = F.col("_pad")

    def span(start: Column, extent: Column, limit: Column) -> tuple[Column, Column]:
        length = F.least(limit, F.lit(maximum), extent + 2 * pad)
        begin = F.least(F.greatest(F.lit(0), start - F.floor((length - extent) / 2)), limit - length)
        return begin.cast("bigint"), length.cast("bigint")

    (wx, ww), (wy, wh) = span(box.x, box.w, F.col("width")), span(box.y, box.h, F.col("height"))
    small = base.filter(side <= maximum).withColumn("wx", wx).withColumn("wy", wy).withColumn("ww", ww).withColumn("wh", wh)
    frame = Box.corners(F.greatest(F.lit(0), box.x - pad), F.greatest(F.lit(0), box.y - pad),
                        F.least(F.col("width"), box.right + pad), F.least(F.col("height"), box.bottom + pad))
    large = (base.filter(side > maximum)
             .withColumn("_y", F.explode(starts(frame.h, maximum, 0.25))).withColumn("_x", F.explode(starts(frame.w, maximum, 0.25)))
             .withColumn("wx", frame.x + F.col("_x")).withColumn("wy", frame.y + F.col("_y"))
             .withColumn("ww", F.least(F.col("_x") + maximum, frame.w) - F.col("_x"))
             .withColumn("wh", F.least(F.col("_y") + maximum, frame.h) - F.col("_y")))
    window = Box(F.col("wx"), F.col("wy"), F.col("ww"), F.col("wh"))
    large = large.filter((window.x < box.right) & (window.y < box.bottom) & (window.right > box.x) & (window.bottom > box.y))
    return small.unionByName(large.select(*small.columns)).drop("_pad")


def recovery_windows(regions: DataFrame, attempt: Column) -> DataFrame:
    """Padded search windows of problem regions with their enlargement factor."""
    box = Box.of()
    pad = 32 * (attempt + 1)
    x0, y0 = F.greatest(F.lit(0), box.x - pad), F.greatest(F.lit(0), box.y - pad)
    x1, y1 = F.least(F.col("width"), box.right + pad), F.least(F.col("height"), box.bottom + pad)
    out = (regions.withColumn("wx", x0.cast("bigint")).withColumn("wy", y0.cast("bigint"))
           .withColumn("wr", x1.cast("bigint")).withColumn("wb", y1.cast("bigint")))
    return out.withColumn("scale", F.when(F.greatest(F.col("wr") - F.col("wx"), F.col("wb") - F.col("wy")) < 512, 2).otherwise(1)) \
        .withColumn("valid", (F.col("wr") > F.col("wx")) & (F.col("wb") > F.col("wy")))


def to_global(box: Box, window: Box, scale: Column) -> Box:
    """Box found in an enlarged window, back in scene pixels and clipped to the window."""
    at = lambda origin, v: origin + half_even(v / scale)
    return Box.corners(F.greatest(window.x, at(window.x, box.x)), F.greatest(window.y, at(window.y, box.y)),
                       F.least(window.right, at(window.x, box.right)), F.least(window.bottom, at(window.y, box.bottom)))
