"""Masks as tables of horizontal runs ``(scene_id, mask_id, y, x0, x1)``, half-open.

Pixel work is interval work on runs cut at strip borders, so it spreads over
(scene, y, strip) and a scene holding a third of all rows is still many small groups:
a strip has at most ``STRIP`` distinct columns, whatever its depth.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spatialqa.functions.boxes import Box
from spatialqa.operators.ordered import top_k
from spatialqa.operators.tiles import starts
from spatialqa.session import FOLDED_ROWS, discard, materialize, unfolded

STRIP = 128
ROW = ["scene_id", "y"]
#: Rows of a tile; a tile is one strip wide.
BAND = 32
TILE = ["scene_id", "_band", "_s"]


def on_strips(runs: DataFrame, strip: int = STRIP) -> DataFrame:
    """Runs cut at strip borders, with the strip number in ``_s``."""
    s = F.lit(strip).cast("bigint")
    cut = runs.withColumn("_s", F.explode(F.sequence(F.floor(F.col("x0") / s), F.floor((F.col("x1") - 1) / s))))
    return unfolded(cut.withColumn("x0", F.greatest(F.col("x0"), F.col("_s") * s))
                    .withColumn("x1", F.least(F.col("x1"), (F.col("_s") + 1) * s)))


def rect_runs(boxes: DataFrame) -> DataFrame:
    """One run per row of each box, clipped to ``width`` x ``height`` when present; other columns stay."""
    box = Box.of()
    x0, y0, x1, y1 = box.x, box.y, box.right, box.bottom
    if "width" in boxes.columns:
        zero = F.lit(0)
        x0, y0, x1, y1 = F.greatest(x0, zero), F.greatest(y0, zero), F.least(x1, F.col("width")), F.least(y1, F.col("height"))
    rest = [c for c in boxes.columns if c not in ("x", "y", "w", "h")]
    long = lambda c: c.cast("bigint")
    return unfolded(boxes.select(*rest, long(x0).alias("x0"), long(x1).alias("x1"), long(y0).alias("_y0"), long(y1).alias("_y1"))
                    .filter((F.col("x1") > F.col("x0")) & (F.col("_y1") > F.col("_y0")))
                    .withColumn("y", F.explode(F.sequence(F.col("_y0"), F.col("_y1") - 1))).drop("_y0", "_y1"))


def box_tiles(boxes: DataFrame, rows: int) -> DataFrame:
    """Boxes once for each tile they meet (``_band``, ``_s``), dealt to tasks by tile: about ``FOLDED_ROWS`` of them a task for ``rows`` boxes.

    Runs that unfold from a box in there and keep both columns are grouped by tile and row without another
    shuffle: a box travels once or a few times instead of each of its runs.
    """
    box, band, s = Box.of(), F.lit(BAND).cast("bigint"), F.lit(STRIP).cast("bigint")
    met = boxes.filter("w > 0 and h > 0").withColumn("_band", F.explode(F.sequence(F.floor(box.y / band), F.floor((box.bottom - 1) / band))))
    met = met.withColumn("_s", F.explode(F.sequence(F.floor(box.x / s), F.floor((box.right - 1) / s))))
    # Fewer tasks than a shuffle has would be dealt again by the next join.
    least = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met.repartition(max(least, -(-2 * rows // FOLDED_ROWS)), *TILE)


def clip_tiles(tiles: DataFrame, regions: DataFrame) -> DataFrame:
    """Runs in tiles cut to the pixels of ``regions``; each tile meets its regions as one row, so runs stay where they lie."""
    solid = union_runs(regions).withColumn("_band", F.floor(F.col("y") / F.lit(BAND))).withColumn("_s", F.floor(F.col("x0") / F.lit(STRIP)))
    rows = solid.groupBy(*TILE, "y").agg(F.collect_list(F.struct("x0", "x1")).alias("_e"))
    open_ = rows.groupBy(*TILE).agg(F.map_from_entries(F.collect_list(F.struct("y", "_e"))).alias("_open"))
    met = unfolded(tiles).join(open_, TILE).withColumn("_e", F.explode(F.col("_open")[F.col("y")]))
    return (met.withColumn("x0", F.greatest("x0", "_e.x0")).withColumn("x1", F.least("x1", "_e.x1")).filter("x0 < x1").select(*tiles.columns))


def to_runs(pixels: DataFrame, keys: list[str] = ["scene_id", "mask_id"], threshold: int | None = None) -> DataFrame:
    """Maximal runs of foreground pixels; with ``threshold`` foreground is ``value`` strictly above it."""
    if threshold is not None:
        pixels = threshold_pixels(pixels, threshold)
    ones = pixels.select(*keys, F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x0"), (F.col("x") + 1).cast("bigint").alias("x1"))
    return union_runs(ones, keys, maximal=True)


def threshold_pixels(pixels: DataFrame, threshold: int = 8, value: str = "value") -> DataFrame:
    return pixels.filter(F.col(value) > threshold)


def _islands(runs: DataFrame, group: list[str]) -> DataFrame:
    order = Window.partitionBy(*group).orderBy("x0", "x1")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("_new", F.when(reach.isNull() | (F.col("x0") > reach), 1).otherwise(0))
    numbered = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*group, "_island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_island")


def union_runs(runs: DataFrame, keys: list[str] = ["scene_id"], *, maximal: bool = False, strip: int = STRIP) -> DataFrame:
    """Disjoint runs covering the same pixels, per ``keys`` and row.

    Copies of a run collapse map-side first. Pieces end at strip borders unless ``maximal``.
    """
    keys = list(dict.fromkeys([*keys, "y"]))
    cut = on_strips(runs.select(*keys, "x0", "x1"), strip)
    widest = cut.groupBy(*keys, "_s", "x0").agg(F.max("x1").alias("x1"))
    pieces = _islands(widest, [*keys, "_s"])
    return _islands(pieces.drop("_s"), keys) if maximal else pieces.drop("_s")


def elementary(cut: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of a row and strip (``keys``) cut between neighbouring ends of all of them; other columns stay.

    A strip has at most ``STRIP + 1`` distinct ends, so the set of them is small whatever the depth, and one window attaches it to every run.
    """
    group = Window.partitionBy(*keys)
    ends = F.array_sort(F.array_union(F.collect_set("x0").over(group), F.collect_set("x1").over(group)))
    inner = F.filter("_c", lambda c: (c >= F.col("x0")) & (c <= F.col("x1")))
    pieces = cut.withColumn("_c", ends).withColumn("_c", inner).withColumn("_n", F.size("_c") - 1)
    pair = F.arrays_zip(F.slice("_c", F.lit(1), F.col("_n")).alias("p0"), F.slice("_c", F.lit(2), F.col("_n")).alias("p1"))
    return unfolded(pieces.select(*(c for c in cut.columns if c not in ("x0", "x1")), F.inline(pair).alias("x0", "x1")))


def pixel_count(runs: DataFrame, keys: list[str], name: str = "pixels") -> DataFrame:
    return runs.groupBy(*keys).agg(F.sum(F.col("x1") - F.col("x0")).cast("bigint").alias(name))


def shared_pieces(a: DataFrame, b: DataFrame, on: list[str] = ROW) -> DataFrame:
    """``a`` cut to the pixels of ``b`` on the same scene row; columns of ``a`` plus extra ones of ``b``.

    ``b`` should be disjoint per ``on`` (a union) unless every overlap is wanted.
    """
    extra = [c for c in b.columns if c not in (*on, "x0", "x1", "_s")]
    left = on_strips(a)
    right = on_strips(b).select(*on, "_s", F.col("x0").alias("_b0"), F.col("x1").alias("_b1"), *extra)
    x0, x1 = F.greatest("x0", "_b0"), F.least("x1", "_b1")
    return (left.join(right, [*on, "_s"]).filter((F.col("x0") < F.col("_b1")) & (F.col("_b0") < F.col("x1")))
            .withColumn("_n0", x0).withColumn("_n1", x1).drop("x0", "x1", "_b0", "_b1", "_s")
            .withColumnRenamed("_n0", "x0").withColumnRenamed("_n1", "x1"))


def run_overlap(pairs: DataFrame, a: DataFrame, b: DataFrame, a_id: str, b_id: str, mask: str = "mask_id") -> DataFrame:
    """Common pixels of chosen mask pairs: ``pairs(scene_id, a_id, b_id)`` -> plus ``common``."""
    left = pairs.select("scene_id", a_id, b_id).join(unfolded(a).select("scene_id", F.col(mask).alias(a_id), "y", F.col("x0").alias("_a0"), F.col("x1").alias("_a1")), ["scene_id", a_id])
    right = unfolded(b).select("scene_id", F.col(mask).alias(b_id), "y", F.col("x0").alias("_b0"), F.col("x1").alias("_b1"))
    width = F.least("_a1", "_b1") - F.greatest("_a0", "_b0")
    common = left.join(right, ["scene_id", b_id, "y"]).filter(width > 0).groupBy("scene_id", a_id, b_id).agg(F.sum(width).cast("bigint").alias("common"))
    return pairs.join(common, ["scene_id", a_id, b_id], "left").fillna(0, ["common"])


def run_difference(a: DataFrame, b: DataFrame, on: list[str] = ROW) -> DataFrame:
    """Pixels of ``a`` that ``b`` does not cover; other columns of ``a`` stay."""
    s = F.lit(STRIP).cast("bigint")
    solid = on_strips(union_runs(b, on))
    order = Window.partitionBy(*on, "_s").orderBy("x0")
    before = solid.select(*on, "_s", F.coalesce(F.lag("x1").over(order), F.col("_s") * s).alias("_g0"), F.col("x0").alias("_g1"))
    after = solid.groupBy(*on, "_s").agg(F.max("x1").alias("_g0")).withColumn("_g1", (F.col("_s") + 1) * s)
    gaps = before.unionByName(after)
    joined = on_strips(a).join(gaps, [*on, "_s"], "left")
    x0 = F.when(F.col("_g0").isNull(), F.col("x0")).otherwise(F.greatest("x0", "_g0"))
    x1 = F.when(F.col("_g1").isNull(), F.col("x1")).otherwise(F.least("x1", "_g1"))
    return joined.withColumn("_n0", x0).withColumn("_n1", x1).filter(F.col("_n0") < F.col("_n1")) \
        .drop("x0", "x1", "_g0", "_g1", "_s").withColumnRenamed("_n0", "x0").withColumnRenamed("_n1", "x1").select(*a.columns)


def clip_runs(runs: DataFrame, roi: DataFrame, on: list[str] = ["scene_id"]) -> DataFrame:
    """Runs cut to a region and moved to its origin.

    ``roi(scene_id, rx0, ry0, rx1, ry1, width, height)``; ``runs`` may carry
    ``mask_w, mask_h``: a mask the size of the region is taken as already local, a mask the
    size of the scene is cut, any other size is an error.
    """
    out = unfolded(runs).join(roi, on)
    if "mask_w" in runs.columns:
        local = (F.col("mask_w") == F.col("rx1") - F.col("rx0")) & (F.col("mask_h") == F.col("ry1") - F.col("ry0"))
        whole = (F.col("mask_w") == F.col("width")) & (F.col("mask_h") == F.col("height"))
        out = out.withColumn("_local", F.when(whole, False).when(local, True)
                             .otherwise(F.raise_error(F.lit("mask must be scene-sized or region-sized")).cast("boolean")))
    else:
        out = out.withColumn("_local", F.lit(False))
    shift = lambda c, o: F.when(F.col("_local"), F.col(c)).otherwise(F.col(c) - F.col(o))
    out = (out.withColumn("_x0", F.greatest(F.lit(0), shift("x0", "rx0")))
           .withColumn("_x1", F.least(F.col("rx1") - F.col("rx0"), shift("x1", "rx0"))).withColumn("_y", shift("y", "ry0")))
    out = out.filter((F.col("_x0") < F.col("_x1")) & (F.col("_y") >= 0) & (F.col("_y") < F.col("ry1") - F.col("ry0")))
    rest = [c for c in runs.columns if c not in ("y", "x0", "x1")]
    return out.select(*rest, F.col("_y").alias("y"), F.col("_x0").alias("x0"), F.col("_x1").alias("x1"))


def covered_fraction(boxes: DataFrame, cover: DataFrame, ident: str) -> DataFrame:
    """Box columns plus ``covered`` pixels and ``fraction`` of the box area."""
    rows = rect_runs(boxes.select("scene_id", ident, *"xywh"))
    hits = pixel_count(shared_pieces(rows, union_runs(cover)), [ident], "covered")
    out = boxes.join(hits, ident, "left").fillna(0, ["covered"])
    return out.withColumn("fraction", F.try_divide(F.col("covered"), Box.of().area))


def drop_covered(boxes: DataFrame, cover: DataFrame, ident: str = "det_id", threshold: float = 0.85) -> DataFrame:
    """Boxes less than ``threshold`` covered by accepted masks."""
    return covered_fraction(boxes, cover, ident).filter(F.col("fraction") < threshold).select(*boxes.columns)


def coverage(objects: DataFrame, runs: DataFrame, eligible: DataFrame) -> DataFrame:
    """Accepted and candidate coverage of the eligible pixels of each scene.

    ``objects(scene_id, mask_id, status, usable)``; ``eligible`` holds runs of opaque pixels.
    """
    solid = union_runs(eligible)
    usable = unfolded(runs).join(objects.filter("usable").select("scene_id", "mask_id", "status"), ["scene_id", "mask_id"])
    part = lambda df, name: pixel_count(shared_pieces(union_runs(df), solid), ["scene_id"], name)
    total = pixel_count(solid, ["scene_id"], "eligible_pixels")
    out = (total.join(part(usable.filter(F.col("status") == "pass"), "accepted"), "scene_id", "left")
           .join(part(usable, "candidate"), "scene_id", "left").fillna(0, ["accepted", "candidate"]))
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("eligible_pixels")), F.lit(0.0))
    return (out.withColumn("accepted_coverage", share("accepted")).withColumn("candidate_coverage", share("candidate"))
            .withColumn("remaining_pixels", F.col("eligible_pixels") - F.col("accepted")))


def cells(scenes: DataFrame, size: int = 512) -> DataFrame:
    """Grid cells of a scene; the last row and column are aligned to the far edge and may overlap."""
    out = (scenes.withColumn("y", F.explode(starts(F.col("height"), size, 0.0)))
           .withColumn("x", F.explode(starts(F.col("width"), size, 0.0))))
    return unfolded(out.withColumn("w", F.least(F.lit(size), F.col("width") - F.col("x")).cast("bigint"))
                    .withColumn("h", F.least(F.lit(size), F.col("height") - F.col("y")).cast("bigint")).drop("width", "height"))


def uncovered_cells(scenes: DataFrame, accepted: DataFrame, eligible: DataFrame | None = None, size: int = 512, k: int | None = 16) -> DataFrame:
    """Uncovered fraction of the eligible pixels in each cell, worst ``k`` per scene.

    Without ``eligible`` every scene pixel counts.
    """
    grid = cells(scenes.select("scene_id", "width", "height"), size).withColumn("cell_id", F.concat_ws(":", "scene_id", "y", "x"))
    rows = rect_runs(grid.select("scene_id", "cell_id", *"xywh"))
    solid = union_runs(accepted)
    if eligible is None:
        valid = grid.select("cell_id", Box.of().area.alias("valid"))
    else:
        open_ = union_runs(eligible)
        valid = pixel_count(shared_pieces(rows, open_), ["cell_id"], "valid")
        solid = shared_pieces(solid, open_)
    hit = pixel_count(shared_pieces(rows, solid), ["cell_id"], "hit")
    out = grid.join(valid, "cell_id", "left").join(hit, "cell_id", "left").fillna(0, ["valid", "hit"])
    out = out.withColumn("uncovered_fraction", F.when(F.col("valid") > 0, (F.col("valid") - F.col("hit")) / F.col("valid")).otherwise(0.0))
    out = out.select("scene_id", *"xywh", "uncovered_fraction")
    return out if k is None else top_k(out, ["scene_id"], [-F.col("uncovered_fraction"), F.col("y"), F.col("x")], k)


def mask_stats(runs: DataFrame, boxes: DataFrame, padding: int = 0) -> DataFrame:
    """Tight box, pixel count, occupancy, border contact and fraction outside the detector box.

    ``boxes(scene_id, mask_id, x, y, w, h, width, height)``; an empty mask has null tight box.
    """
    joined = unfolded(runs).join(boxes, ["scene_id", "mask_id"]).select(
        "scene_id", "mask_id", runs["y"].alias("ry"), "x0", "x1", boxes["x"].alias("bx"), boxes["y"].alias("by"), "w", "h", "width", "height")
    inside = F.when((F.col("ry") >= F.col("by")) & (F.col("ry") < F.col("by") + F.col("h")),
                    F.greatest(F.lit(0).cast("bigint"), F.least(F.col("x1"), F.col("bx") + F.col("w")) - F.greatest(F.col("x0"), F.col("bx")))).otherwise(0)
    edge = (F.col("ry") == 0) | (F.col("ry") == F.col("height") - 1) | (F.col("x0") == 0) | (F.col("x1") == F.col("width"))
    agg = joined.groupBy("scene_id", "mask_id").agg(
        F.min("x0").alias("_x0"), F.max("x1").alias("_x1"), F.min("ry").alias("_y0"), (F.max("ry") + 1).alias("_y1"),
        F.sum(F.col("x1") - F.col("x0")).cast("bigint").alias("pixels"), F.sum(inside).cast("bigint").alias("inside"), F.max(edge).alias("touches_edge"))
    out = boxes.join(agg, ["scene_id", "mask_id"], "left").fillna(0, ["pixels", "inside"]).fillna(False, ["touches_edge"])
    low = lambda c: F.greatest(F.lit(0), F.col(c) - padding)
    high = lambda c, top: F.least(F.col(top), F.col(c) + padding)
    area = Box.of().area
    return (out.withColumn("tight_x", low("_x0")).withColumn("tight_y", low("_y0"))
            .withColumn("tight_w", high("_x1", "width") - F.col("tight_x")).withColumn("tight_h", high("_y1", "height") - F.col("tight_y"))
            .withColumn("tight_x", F.when(F.col("_x0").isNotNull(), F.col("tight_x"))).withColumn("tight_y", F.when(F.col("_x0").isNotNull(), F.col("tight_y")))
            .withColumn("tight_w", F.when(F.col("_x0").isNotNull(), F.col("tight_w"))).withColumn("tight_h", F.when(F.col("_x0").isNotNull(), F.col("tight_h")))
            .withColumn("occupancy", F.coalesce(F.try_divide(F.col("inside"), area), F.lit(0.0)))
            .withColumn("outside_fraction", F.when(F.col("pixels") > 0, 1.0 - F.col("inside") / F.col("pixels")).otherwise(0.0))
            .drop("_x0", "_x1", "_y0", "_y1"))


def pivots(runs: DataFrame, crops: DataFrame) -> DataFrame:
    """Ground contact point inside each crop and its scene depth ``z_order``.

    ``crops(scene_id, mask_id, x, y, w, h)``. The pivot is the mean column of the lowest
    row; an empty mask uses the lower middle.
    """
    rows = runs.groupBy("scene_id", "mask_id", "y").agg(
        F.sum((F.col("x0") + F.col("x1") - 1) * (F.col("x1") - F.col("x0")) / 2.0).alias("sx"), F.sum(F.col("x1") - F.col("x0")).alias("n"))
    low = rows.groupBy("scene_id", "mask_id").agg(F.max(F.struct(F.col("y").alias("low_y"), (F.col("sx") / F.col("n")).alias("mean_x"))).alias("_l"))
    out = crops.join(low.select("scene_id", "mask_id", "_l.*"), ["scene_id", "mask_id"], "left")
    return (out.withColumn("pivot_x", F.coalesce(F.col("mean_x") - F.col("x") + 0.5, F.col("w") / 2.0))
            .withColumn("pivot_y", F.coalesce(F.col("low_y") - F.col("y") + 0.5, F.col("h") * 0.95))
            .withColumn("z_order", F.col("y") + F.col("pivot_y")).drop("mean_x", "low_y"))


def mask_components(runs: DataFrame, keys: list[str] = ["scene_id", "mask_id"]) -> DataFrame:
    """8-connected components: ``component`` (its smallest run number), ``pixels`` and box per component.

    Runs of neighbouring rows that touch within one column share a component. Rows with one
    run each that touch in turn are one node, named by its smallest run. Labels
    shrink to the smallest neighbour, then jump to the label of their label, each round.
    """
    solid = union_runs(runs, keys, maximal=True).withColumn("_run", F.xxhash64(*keys, "y", "x0"))
    alone = solid.withColumn("_alone", F.count(F.lit(1)).over(Window.partitionBy(*keys, "y")) == 1)
    order = Window.partitionBy(*keys).orderBy("y", "x0")
    last = lambda c: F.lag(c).over(order)
    goes_on = F.col("_alone") & last("_alone") & (last("y") == F.col("y") - 1) & (F.col("x0") <= last("x1")) & (last("x0") <= F.col("x1"))
    chained = alone.withColumn("_chain", F.sum(F.when(goes_on, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    chain, fresh = Window.partitionBy(*keys, "_chain"), Window.partitionBy(*keys).orderBy("_chain", "y", "x0")
    width = F.col("x1") - F.col("x0")
    whole = [F.sum(width).over(chain).alias("_pixels"), F.min("x0").over(chain).alias("_left"), F.max("x1").over(chain).alias("_right"), F.min("y").over(chain).alias("_y0"), F.max("y").over(chain).alias("_y1")]
    named = chained.select(*keys, "y", "x0", "x1", "_chain", F.min("_run").over(chain).alias("_run"), *whole)
    same = lambda near: F.coalesce(near("_chain", 1).over(fresh) == F.col("_chain"), F.lit(False))
    # Only the ends of a chain touch another one, so nothing between them is written, joined or labelled.
    ends = materialize(named.withColumn("_first", ~same(F.lag)).withColumn("_last", ~same(F.lead)).filter("_first or _last").drop("_chain"))
    up = ends.filter("_last").select(*keys, (F.col("y") + 1).alias("y"), F.col("x0").alias("_u0"), F.col("x1").alias("_u1"), F.col("_run").alias("_up"))
    firsts = ends.filter("_first")
    touch = unfolded(firsts).join(up, [*keys, "y"]).filter((F.col("x0") <= F.col("_u1")) & (F.col("_u0") <= F.col("x1")))
    links = touch.select(F.col("_run").alias("a"), F.col("_up").alias("b"))
    labels = connected(firsts.select(F.col("_run").alias("id")).distinct(), links)
    out = unfolded(firsts).join(labels.withColumnRenamed("id", "_run"), "_run")
    return out.groupBy(*keys, "label").agg(
        F.sum("_pixels").cast("bigint").alias("pixels"), F.min("_left").alias("x0"), F.max("_right").alias("x1"),
        F.min("_y0").alias("y0"), (F.max("_y1") + 1).alias("y1")).withColumnRenamed("label", "component")


def connected(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Smallest reachable id per node (``id, label``), by neighbour minimum and pointer jumping."""
    both = materialize(links.filter("a <> b").union(links.filter("a <> b").select("b", "a")).distinct())
    old = state = materialize(nodes.select("id", F.col("id").alias("label")))
    while True:
        near = both.join(state.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        low = state.join(near, "id", "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        jump = state.select(F.col("id").alias("low"), F.col("label").alias("beyond"))
        moved = materialize(low.join(jump, "low", "left").select(
            "id", F.least("low", F.coalesce("beyond", "low")).alias("label"), (F.least("low", F.coalesce("beyond", "low")) < F.col("label")).alias("changed")))
        state = moved.select("id", "label")
        discard(old)
        old = moved
        if moved.filter("changed").isEmpty():
            discard(both)
            return state


def component_summary(components: DataFrame, keys: list[str] = ["scene_id", "mask_id"], small: int = 4) -> DataFrame:
    """Components per mask, the largest one and how many small ones stand apart from it."""
    largest = F.max(F.struct("pixels", (-F.col("component")).alias("c")))
    return (components.groupBy(*keys).agg(F.count(F.lit(1)).alias("components"), F.max("pixels").alias("largest"),
                                          F.count_if(F.col("pixels") <= small).alias("_small"), largest["pixels"].alias("_l"))
            .withColumn("small_regions", F.col("_small") - (F.col("_l") <= small).cast("int")).drop("_small", "_l"))


def enclosed_holes(runs: DataFrame, frame: DataFrame, keys: list[str] = ["scene_id", "mask_id"]) -> DataFrame:
    """Background components that do not reach the frame; ``frame(keys, x, y, w, h)``."""
    full = rect_runs(frame.select(*keys, *"xywh"))
    background = run_difference(full, runs.select(*keys, "y", "x0", "x1"), [*keys, "y"])
    parts = mask_components(background, keys).join(frame, keys)
    inside = ((F.col("x0") > F.col("x")) & (F.col("y0") > F.col("y")) & (F.col("x1") < F.col("x") + F.col("w")) & (F.col("y1") < F.col("y") + F.col("h")))
    return parts.filter(inside).select(*keys, "component", "pixels", "x0", "x1", "y0", "y1")
