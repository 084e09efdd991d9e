"""Operators that need pixel values: ``pixels(scene_id, x, y, r, g, b, a)``."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spatialqa.operators.ordered import top_k
from spatialqa.operators.runs import STRIP, TILE, elementary, on_strips, pixel_count, rect_runs, run_difference, shared_pieces, union_runs
from spatialqa.session import unfolded

RGBA = ["r", "g", "b", "a"]


def _strip(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("_s", F.floor(F.col("x") / F.lit(STRIP)))


def pixels_in(pixels: DataFrame, runs: DataFrame) -> DataFrame:
    """Pixels with the extra columns of every run that holds them."""
    cut = on_strips(runs)
    hit = _strip(unfolded(pixels)).join(cut, ["scene_id", "y", "_s"]).filter((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")))
    return hit.drop("_s", "x0", "x1")


def cutout(pixels: DataFrame, runs: DataFrame, crops: DataFrame | None = None, mask: str = "mask_id") -> DataFrame:
    """Pixels of each mask with alpha ``(a*m+127) div 255``; ``m`` is the run's value, 255 when absent.

    ``crops(scene_id, mask_id, x, y, w, h)`` adds crop-local ``cx, cy`` and keeps only the crop.
    """
    value = F.col("m") if "m" in runs.columns else F.lit(255)
    out = pixels_in(pixels, runs).withColumn("a", F.floor((F.col("a") * value + 127) / 255).cast("int")).drop("m")
    if crops is None:
        return out
    box = crops.select("scene_id", mask, *(F.col(k).alias(f"_{k}") for k in "xywh"))
    cx, cy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    out = out.join(box, ["scene_id", mask]).withColumn("cx", cx).withColumn("cy", cy)
    return out.filter((F.col("cx") >= 0) & (F.col("cy") >= 0) & (F.col("cx") < F.col("_w")) & (F.col("cy") < F.col("_h"))).drop(*(f"_{k}" for k in "xywh"))


def cutout_runs(layers: DataFrame, runs: DataFrame, on: list[str]) -> DataFrame:
    """``cutout`` of layers given as runs of one colour, each with the masks that have its ``on`` (its own, say): pieces ``x0, x1`` with their alpha.

    ``layers`` and ``runs`` share ``scene_id, y`` and ``on``; all pixels of a piece have one alpha, so none is unfolded.
    """
    value = F.col("m") if "m" in runs.columns else F.lit(255)
    right = runs.withColumnsRenamed({"x0": "_b0", "x1": "_b1"})
    x0, x1 = F.greatest("x0", "_b0"), F.least("x1", "_b1")
    met = unfolded(layers).join(right, ["scene_id", *on, "y"]).withColumn("_n0", x0).withColumn("_n1", x1).filter("_n0 < _n1").drop("x0", "x1", "_b0", "_b1")
    return met.withColumnsRenamed({"_n0": "x0", "_n1": "x1"}).withColumn("a", F.floor((F.col("a") * value + 127) / 255).cast("int")).drop("m")


def appearance(pixels: DataFrame, boxes: DataFrame, ident: str = "det_id") -> DataFrame:
    """64-bin colour histogram per box, summing to 1, over all of its pixels."""
    rows = rect_runs(boxes.select("scene_id", ident, *"xywh"))
    bin_ = (F.floor(F.col("r") / 64) * 16 + F.floor(F.col("g") / 64) * 4 + F.floor(F.col("b") / 64)).cast("int")
    counts = pixels_in(pixels, rows).groupBy(ident, bin_.alias("_bin")).agg(F.count(F.lit(1)).alias("n"))
    # At most 64 entries per box.
    packed = counts.groupBy(ident).agg(F.map_from_entries(F.collect_list(F.struct("_bin", "n"))).alias("m"), F.sum("n").alias("t"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)) / F.col("t"))
    return packed.select(ident, dense.alias("appearance"))


def composite(layers: DataFrame, order: list[Column]) -> DataFrame:
    """Source-over blend of layer pixels in ``order`` (back to front), per scene pixel.

    Eight-bit straight-alpha blending, rounded after every layer. An opaque pixel hides all
    below it, so a stack starts at its topmost opaque layer: an aggregate finds that first,
    and only the few translucent layers above it are gathered.
    """
    rank = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    spot = ["scene_id", "x", "y"]
    ranked = layers.filter(F.col("a") > 0).withColumn("_rank", rank)
    solid = ranked.filter(F.col("a") == 255).groupBy(*spot).agg(F.max("_rank").alias("_solid"))
    seen = unfolded(ranked).join(solid, spot, "left").filter(F.col("_solid").isNull() | (F.col("_rank") >= F.col("_solid")))
    return _blended(seen, spot)


def composite_runs(layers: DataFrame, order: list[Column]) -> DataFrame:
    """``composite`` of layers given as runs of one colour, ``scene_id, y, x0, x1, r, g, b, a``: runs of the blended colour.

    Every layer covers an elementary segment whole or not at all, so a segment is blended once for all of its pixels. Runs in tiles
    (``box_tiles``) are not shuffled, others once.
    """
    tiled = "_band" in layers.columns
    keys = [*(TILE if tiled else ["scene_id", "_s"]), "y"]
    rank = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    ranked = (layers if tiled else on_strips(layers)).filter(F.col("a") > 0).select(*keys, "x0", "x1", *RGBA, rank.alias("_rank"))
    segment = [*keys, "x0", "x1"]
    solid = F.max(F.when(F.col("a") == 255, F.col("_rank"))).over(Window.partitionBy(*segment))
    seen = elementary(ranked, keys).withColumn("_solid", solid).filter(F.col("_solid").isNull() | (F.col("_rank") >= F.col("_solid")))
    return _blended(seen, segment).drop("_band", "_s")


def _blended(seen: DataFrame, spot: list[str]) -> DataFrame:
    """Layers of each ``spot`` blended by ``_rank``."""
    stacks = seen.groupBy(*spot).agg(F.array_sort(F.collect_list(F.struct("_rank", *(F.col(c).cast("bigint").alias(c) for c in RGBA)))).alias("_st"))
    zero = F.struct(*(F.lit(0).cast("bigint").alias(c) for c in RGBA))
    div255 = lambda v: F.floor((F.floor(v / 256) + v) / 256)
    bits = 128  # sub-level precision of the blend weights

    def over(below: Column, top: Column) -> Column:
        mixed = top["a"] * 255 + below["a"] * (255 - top["a"])
        weight = F.floor(top["a"] * 255 * 255 * bits / mixed)
        channel = lambda c: F.floor(div255(top[c] * weight + below[c] * (255 * bits - weight) + 128 * bits) / bits)
        return F.struct(*(channel(c).cast("bigint").alias(c) for c in "rgb"), div255(mixed + 128).cast("bigint").alias("a"))

    return stacks.withColumn("_out", F.aggregate("_st", zero, over)).select(*spot, *(F.col(f"_out.{c}").cast("int").alias(c) for c in RGBA))


def layer_depth(kind: Column, z_order: Column) -> Column:
    """Depth of residual (-2), terrain (-1) and object layers."""
    return F.when(kind == "residual", -2.0).when(kind == "terrain", -1.0).otherwise(z_order)


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    spot = ["scene_id", "x", "y"]
    side = lambda df, s: unfolded(df).select(*spot, *(F.col(k).alias(f"{k}_{s}") for k in RGBA))
    return side(a, "a").join(side(b, "b"), spot, "full_outer").fillna(0, [f"{k}_{s}" for k in RGBA for s in "ab"])


def similarity(a: DataFrame, b: DataFrame, scenes: DataFrame) -> DataFrame:
    """1 minus the mean absolute RGBA difference over the whole canvas; absent pixels are zero."""
    return paired_similarity(_both(a, b), scenes)


def paired_similarity(both: DataFrame, scenes: DataFrame) -> DataFrame:
    """``similarity`` of pixels that hold both sides already: ``scene_id, r_a, ..., a_a, r_b, ..., a_b``."""
    gap = sum((F.abs(F.col(f"{k}_a") - F.col(f"{k}_b")) for k in RGBA), F.lit(0))
    total = both.groupBy("scene_id").agg(F.sum(gap).cast("bigint").alias("_gap"))
    area = 4.0 * F.col("width") * F.col("height")
    return scenes.join(total, "scene_id", "left").select("scene_id", (1.0 - F.coalesce("_gap", F.lit(0)) / area / 255.0).alias("similarity"))


def alpha_diff(a: DataFrame, b: DataFrame, scenes: DataFrame) -> DataFrame:
    """Missing, extra and strongly different pixels on premultiplied colour, with their shares."""
    return paired_alpha_diff(_both(a, b), scenes)


def paired_alpha_diff(both: DataFrame, scenes: DataFrame) -> DataFrame:
    """``alpha_diff`` of pixels that hold both sides already: ``scene_id, r_a, ..., a_a, r_b, ..., a_b``."""
    unit = lambda c: F.col(c) / 255.0
    sa, sb = unit("a_a"), unit("a_b")
    diff = F.greatest(*(F.abs(unit(f"{k}_a") * sa - unit(f"{k}_b") * sb) for k in "rgb"))
    mean = (sum((F.abs(unit(f"{k}_a") * sa - unit(f"{k}_b") * sb) for k in "rgb"), F.lit(0.0)) + F.abs(sa - sb)) / 4.0
    out = both.groupBy("scene_id").agg(F.count_if(sa > sb + 0.03).alias("missing_pixels"), F.count_if(sb > sa + 0.03).alias("extra_pixels"),
                                       F.count_if(diff > 0.12).alias("high_difference_pixels"), F.sum(mean).alias("_mean"))
    area = F.col("width") * F.col("height")
    out = scenes.select("scene_id", "width", "height").join(out, "scene_id", "left").fillna(0)
    return out.select("scene_id", "missing_pixels", "extra_pixels", "high_difference_pixels", (F.col("missing_pixels") / area).alias("alpha_gap"),
                      (F.col("extra_pixels") / area).alias("extra_alpha"), (F.col("_mean") / area).alias("mean_pixel_difference"))


def review_cells(scenes: DataFrame, eligible: DataFrame, boxes: DataFrame, terrain: DataFrame, edges: DataFrame, size: int = STRIP,
                 edge_density: float = 0.08, unassigned: float = 0.01, k: int = 12) -> DataFrame:
    """Cells with enough free pixels that look textured or unassigned, best ``k`` per scene.

    ``boxes`` are non-terrain objects, ``terrain`` runs of terrain masks, ``edges`` runs of
    edge pixels. Rejoining them keeps everything as runs.
    """
    cover = rect_runs(boxes.select("scene_id", *"xywh").distinct()).select("scene_id", "y", "x0", "x1").unionByName(terrain.select("scene_id", "y", "x0", "x1"))
    free = run_difference(union_runs(eligible), cover)
    def by_cell(runs: DataFrame, name: str) -> DataFrame:
        cut = on_strips(runs, size).withColumn("cy", F.floor(F.col("y") / F.lit(size)))
        return cut.groupBy("scene_id", "cy", F.col("_s").alias("cx")).agg(F.sum(F.col("x1") - F.col("x0")).cast("bigint").alias(name))
    key = ["scene_id", "cy", "cx"]
    hits = by_cell(shared_pieces(union_runs(edges), free), "edge_pixels")
    total = pixel_count(union_runs(eligible), ["scene_id"], "_total")
    out = by_cell(free, "free_pixels").join(hits, key, "left").fillna(0, ["edge_pixels"]).join(total, "scene_id").join(scenes.select("scene_id", "width", "height"), "scene_id")
    score = F.col("edge_pixels") / F.greatest(F.lit(1).cast("bigint"), F.col("free_pixels"))
    share = F.col("free_pixels") / F.greatest(F.lit(1).cast("bigint"), F.col("_total"))
    out = out.withColumn("score", score).filter((F.col("free_pixels") >= 16) & ((F.col("score") >= edge_density) | (share > unassigned)))
    x, y = F.col("cx") * size, F.col("cy") * size
    named = out.select("scene_id", x.alias("x"), y.alias("y"), F.least(F.lit(size), F.col("width") - x).alias("w"), F.least(F.lit(size), F.col("height") - y).alias("h"),
                       "score", F.when(F.col("score") >= edge_density, "MISSED_DETECTION").otherwise("UNASSIGNED_REGION").alias("failure_type"))
    return top_k(named, ["scene_id"], [-F.col("score"), F.col("y"), F.col("x")], k)
