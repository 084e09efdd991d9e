"""Which object owns each visible pixel."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from spatialqa.functions import taxonomy
from spatialqa.operators.layers import layer_order
from spatialqa.operators.runs import ROW, TILE, clip_tiles, elementary, on_strips, pixel_count, run_difference, shared_pieces, union_runs
from spatialqa.session import materialize, packed_rows, unfolded

PAINT_KEYS = ["ownership_priority", "_bottom", "confidence", "seg_score"]


def _segment(stacked: DataFrame) -> list[str]:
    """What names a segment; with its tile, if it has one, so that tiles dealt to tasks stay there."""
    return [*(TILE if "_band" in stacked.columns else ["scene_id", "_s"]), "y", "x0", "x1"]


def _ranked(ordered: DataFrame) -> DataFrame:
    """Adds ``paint_rank`` (a number that sorts like the paint order) and ``owner_no``.

    A global sort spreads over range partitions however large one scene is, and the running
    row id of its output grows along the order. Written once, so every use sees the same ids.
    """
    numbered = packed_rows(materialize(ordered.orderBy("scene_id", "paint_order").withColumn("paint_rank", F.monotonically_increasing_id()).drop("paint_order")))
    first = numbered.groupBy("scene_id", "owner").agg(F.min("paint_rank").alias("owner_no"))
    return packed_rows(numbered.join(first, ["scene_id", "owner"]))


def painters(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """Objects with their owner name and place in the paint order.

    ``objects(scene_id, object_id, category, element_type, ownership_priority, y, h,
    confidence, seg_score)``. Terrain of one class shares an owner.
    """
    surface = F.coalesce(taxonomy.terrain_class(F.col("category")), F.col("category"))
    terrain = F.col("element_type") == "terrain"
    owner = F.when(terrain, F.concat(F.lit("terrain:"), surface)).otherwise(F.concat(F.lit("object:"), F.col("object_id").cast("string")))
    named = objects.withColumn("owner", owner).withColumn("_bottom", F.col("y") + F.col("h"))
    return _ranked(layer_order(named, edges, PAINT_KEYS).drop("_bottom"))


def stack(runs: DataFrame, painted: DataFrame, id_column: str = "object_id") -> DataFrame:
    """Elementary segments with the ``paint_rank`` and ``owner_no`` of every object covering them.

    A segment lies between neighbouring run ends of its strip (``elementary``): one shuffle, no join of runs with segments. Everything stays
    partitioned by (scene, row, strip), which the aggregates over segments reuse. Runs in tiles
    (``tile_runs``) that carry both numbers are not shuffled at all.
    """
    if "_band" in runs.columns:
        cut, keys = runs, [*TILE, "y"]
    else:
        ranks = painted.select("scene_id", id_column, "paint_rank", "owner_no")
        cut, keys = on_strips(unfolded(runs).select("scene_id", id_column, "y", "x0", "x1").join(ranks, ["scene_id", id_column])).drop(id_column), [*ROW, "_s"]
    return elementary(cut.select(*keys, "paint_rank", "owner_no", "x0", "x1"), keys)


def _names(painted: DataFrame, rank: str = "paint_rank") -> DataFrame:
    return painted.select(F.col("paint_rank").alias(rank), "owner", "object_id")


def top_segments(stacked: DataFrame) -> DataFrame:
    """Rank of the last painter of each segment, ``scene_id, y, x0, x1, paint_rank, overlapped``, where it lies."""
    top = stacked.groupBy(*_segment(stacked)).agg(F.max("paint_rank").alias("paint_rank"), F.min("owner_no").alias("_lo"), F.max("owner_no").alias("_hi"))
    return top.withColumn("overlapped", F.col("_lo") != F.col("_hi")).drop("_lo", "_hi", "_s", "_band")


def owned_segments(stacked: DataFrame, painted: DataFrame) -> DataFrame:
    """Last painter of each segment: ``scene_id, y, x0, x1, owner, object_id, overlapped``."""
    return top_segments(stacked).join(_names(painted), "paint_rank").drop("paint_rank")


def owner_pixels(top: DataFrame, painted: DataFrame) -> DataFrame:
    """Visible pixels of each owner, from ``top_segments``: summed by rank before names join, one row an object."""
    return (pixel_count(top, ["paint_rank"], "_n").join(painted.select("scene_id", "owner", "paint_rank"), "paint_rank")
            .groupBy("scene_id", "owner").agg(F.sum("_n").cast("bigint").alias("visible_pixels")))


def conflicts(stacked: DataFrame, painted: DataFrame) -> DataFrame:
    """Pixels each painting record took from another owner: ``scene_id, winner, loser, object_id, pixels``."""
    before = F.lag("owner_no").over(Window.partitionBy(*_segment(stacked)).orderBy("paint_rank"))
    over = stacked.withColumn("_loser", before).filter(F.col("_loser") != F.col("owner_no"))
    taken = over.groupBy("scene_id", "paint_rank", "_loser").agg(F.sum(F.col("x1") - F.col("x0")).cast("bigint").alias("pixels"))
    losers = painted.select(F.col("owner_no").alias("_loser"), F.col("owner").alias("loser")).distinct()
    return taken.join(_names(painted), "paint_rank").join(losers, "_loser").select("scene_id", F.col("owner").alias("winner"), "loser", "object_id", "pixels")


def record_pixels(stacked: DataFrame, painted: DataFrame) -> DataFrame:
    """Visible and occluded pixels of each record; a record sees every pixel its owner keeps inside its mask."""
    # The owner painted last is the one of the largest rank.
    won = F.max_by("owner_no", "paint_rank").over(Window.partitionBy(*_segment(stacked)))
    width = F.col("x1") - F.col("x0")
    seen = F.when(F.col("owner_no") == F.col("_won"), width).otherwise(0)
    sums = stacked.withColumn("_won", won).groupBy("paint_rank").agg(F.sum(seen).cast("bigint").alias("visible_pixels"), F.sum(width - seen).cast("bigint").alias("occluded_pixels"))
    return sums.join(painted.select("scene_id", "object_id", "owner", "paint_rank"), "paint_rank").drop("paint_rank")


def ownership_summary(owned: DataFrame, eligible: DataFrame, keep_residual: bool = True) -> DataFrame:
    """Per scene: eligible, assigned and overlapping pixels; coverage counts before the residual owner."""
    width = F.col("x1") - F.col("x0")
    parts = owned.groupBy("scene_id").agg(F.sum(width).cast("bigint").alias("assigned_pixels"),
                                          F.sum(F.when(F.col("overlapped"), width).otherwise(0)).cast("bigint").alias("overlap_pixels"))
    out = pixel_count(union_runs(eligible), ["scene_id"], "eligible_pixels").join(parts, "scene_id", "left").fillna(0)
    n = F.greatest(F.lit(1).cast("bigint"), F.col("eligible_pixels"))
    out = out.withColumn("unassigned_pixels", F.col("eligible_pixels") - F.col("assigned_pixels"))
    visible = F.col("eligible_pixels") if keep_residual else F.col("assigned_pixels")
    return (out.withColumn("unassigned_ratio", F.col("unassigned_pixels") / n).withColumn("coverage_ratio", 1 - F.col("unassigned_pixels") / n)
            .withColumn("visible_coverage_ratio", visible / n).withColumn("overlap_ratio", F.col("overlap_pixels") / n))


def residual_runs(owned: DataFrame, eligible: DataFrame) -> DataFrame:
    """Eligible pixels nobody owns."""
    return run_difference(union_runs(eligible), owned.select(*ROW, "x0", "x1"))


def assign_owners(objects: DataFrame, runs: DataFrame, eligible: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(owned segments, stacked segments, painters) inside the eligible pixels."""
    painted = painters(objects, edges)
    open_ = shared_pieces(runs.select("scene_id", "object_id", "y", "x0", "x1"), union_runs(eligible))
    stacked = stack(open_, painted)
    return owned_segments(stacked, painted), stacked, painted


def owners(objects: DataFrame, owned: DataFrame) -> DataFrame:
    """One row per owner: kind, category, members and visible pixels.

    ``objects`` carry ``owner`` (see ``painters``).
    """
    seen = pixel_count(owned, ["scene_id", "owner"], "visible_pixels")
    terrain = F.col("element_type") == "terrain"
    name = F.when(terrain, F.coalesce(taxonomy.terrain_class(F.col("category")), F.col("category"))).otherwise(F.col("category"))
    table = objects.groupBy("scene_id", "owner").agg(F.first("element_type").alias("kind"), F.first(name).alias("category"),
                                                     F.count(F.lit(1)).alias("members"))
    return table.join(seen, ["scene_id", "owner"], "left").fillna(0, ["visible_pixels"])


def stacked_tiles(tiles: DataFrame, painted: DataFrame, eligible: DataFrame) -> DataFrame:
    """``stack`` of the eligible pixels of runs in tiles that carry ``paint_rank`` and ``owner_no``; only tiles of objects were shuffled."""
    return stack(clip_tiles(tiles, eligible), painted)


def terrain_layers(objects: DataFrame, owned: DataFrame, stacked: DataFrame) -> DataFrame:
    """One layer per terrain class: QA status, uncertainty, visible and occluded pixels.

    ``objects`` is ``painters`` output with ``status`` and ``uncertain``; ``owned`` has names or is ``top_segments``.
    """
    ground = objects.filter(F.col("element_type") == "terrain")
    table = ground.groupBy("scene_id", "owner").agg(
        F.when(F.min(F.col("status") == "pass"), "pass").otherwise("manual_review").alias("qa_status"),
        F.max("uncertain").alias("uncertain"), F.count(F.lit(1)).alias("observations"))
    numbers = ground.select("scene_id", "owner", "owner_no").distinct()
    # An owner counts a segment once; summed where segments lie, so that one row an owner and task meets the names.
    covered = pixel_count(stacked.select(*_segment(stacked), "owner_no").distinct(), ["scene_id", "owner_no"], "_all").join(numbers, ["scene_id", "owner_no"]).drop("owner_no")
    seen = pixel_count(owned, ["scene_id", "owner"], "visible_pixels") if "owner" in owned.columns else owner_pixels(owned, objects)
    return (table.join(covered, ["scene_id", "owner"], "left").join(seen, ["scene_id", "owner"], "left").fillna(0, ["_all", "visible_pixels"])
            .withColumn("occluded_pixels", F.col("_all") - F.col("visible_pixels")).drop("_all"))


def accepted_ownership(assets: DataFrame, runs: DataFrame, edges: DataFrame) -> DataFrame:
    """Visible pixels of accepted assets painted by ``z_order`` and occlusion edges."""
    ordered = layer_order(assets, edges, ["z_order"]).withColumn("owner", F.concat(F.lit("object:"), F.col("object_id").cast("string")))
    painted = _ranked(ordered)
    # Every asset is its own owner and has one rank, so pixels are summed before names join.
    stacked = stack(runs, painted)
    top = stacked.groupBy(*_segment(stacked)).agg(F.max("paint_rank").alias("paint_rank"))
    seen = pixel_count(top, ["paint_rank"], "visible_pixels").join(painted.select("scene_id", "object_id", "paint_rank"), "paint_rank").drop("paint_rank")
    return assets.join(seen, ["scene_id", "object_id"], "left").fillna(0, ["visible_pixels"])


def apply_ownership(objects: DataFrame, records: DataFrame) -> DataFrame:
    """Objects after ownership: terrain leaves the list, hidden ones lose asset and crop, status stays.

    ``records`` comes from ``record_pixels``; ``mask_pixels`` is the size of the old mask.
    """
    out = objects.filter(F.col("element_type") != "terrain").join(
        records.select("scene_id", "object_id", "visible_pixels", "occluded_pixels"), ["scene_id", "object_id"], "left")
    hidden = (F.col("visible_pixels") == 0) & (F.col("occluded_pixels") > 0)
    changed = F.col("visible_pixels").isNotNull() & ~hidden & (F.col("visible_pixels") != F.col("mask_pixels"))
    empty = changed & (F.col("visible_pixels") == 0)
    return (out.withColumn("fully_occluded", F.coalesce(hidden, F.lit(False)))
            .withColumn("asset_path", F.when(~F.coalesce(hidden | empty, F.lit(False)), F.col("asset_path")))
            .withColumn("needs_crop", F.coalesce(changed & ~empty, F.lit(False)))
            .withColumn("status", F.when(empty, "manual_review").otherwise(F.col("status")))
            .withColumn("is_failed", F.col("status") != "pass"))
