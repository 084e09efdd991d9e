"""Class-aware greedy suppression, exact, by rounds over cell-local leaders.

Greedy suppression keeps a row when no better kept row of its group overlaps it. The
same answer comes from rounds in which every row that has no live better neighbour is
kept and its neighbours are dropped. To bound the work in crowded places a grid cell lists
only the best ``WIDTH`` live rows that lie on its level: any better neighbour of the same
level shares a cell with a listed row and is in that list too. So a cell never yields more
than ``WIDTH**2`` pairs, and rows further down wait for the next round, when most of them
have been dropped. Smaller boxes are guests of coarser cells: they meet the listed boxes
there, not each other, and wait only where a list ends before them, so a huge box doesn't
hold up the boxes under it. Exact copies of a box collapse beforehand.
"""
from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from spatialqa.functions.boxes import Box, iou
from spatialqa.operators.ordered import first_per, top_k
from spatialqa.operators.overlap import Grid, cell_count, grid_for, on_cells, overlap_join, suffixed
from spatialqa.session import discard, materialize

WIDTH = 256


def _edges(listed: DataFrame, guests: DataFrame | None, ready: DataFrame, keys: list[str], clash: Callable[[Box, Box], Column]) -> DataFrame:
    """(loser, winner, winner surely sees all its better neighbours) among listed rows of a cell and between them and guests."""
    grid = [*keys, "_lv", "_cx", "_cy"]
    side = lambda df, s: df.select(*grid, *(F.col(c).alias(f"{c}_{s}") for c in ["_id", "_ord", *"xywh"]))
    meets = clash(suffixed("a"), suffixed("b"))
    pairs = side(listed, "a").join(side(listed, "b"), grid).filter((F.col("_ord_b") < F.col("_ord_a")) & meets).select(F.col("_id_a").alias("loser"), F.col("_id_b").alias("winner"))
    if guests is not None:
        mixed = side(guests, "a").join(side(listed, "b"), grid).filter(meets)
        worse = F.col("_ord_b") < F.col("_ord_a")
        pairs = pairs.unionByName(mixed.select(F.when(worse, F.col("_id_a")).otherwise(F.col("_id_b")).alias("loser"), F.when(worse, F.col("_id_b")).otherwise(F.col("_id_a")).alias("winner")))
    return pairs.distinct().join(ready.select(F.col("_id").alias("winner"), F.lit(True).alias("full")), "winner", "left").withColumn("full", F.coalesce("full", F.lit(False)))


def _beaten(edges: DataFrame) -> DataFrame:
    """Losers of a fully listed winner that itself loses to nobody."""
    free = (edges.filter("full").select("winner").distinct()
            .join(edges.select(F.col("loser").alias("winner")).distinct(), "winner", "left_anti"))
    return edges.join(free, "winner", "left_semi").select("loser").distinct()


def independent_rows(df: DataFrame, keys: list[str], order: list[Column], ident: str,
                     clash: Callable[[Box, Box], Column], *, width: int = WIDTH, grid: Grid | None = None) -> DataFrame:
    """Ids of the rows a greedy pass in ``order`` would keep (one column, ``ident``).

    ``order`` must be total. ``clash`` says when two overlapping boxes exclude each other.
    """
    rank = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    live = materialize(df.select(*keys, F.col(ident).alias("_id"), rank.alias("_ord"), *"xywh"))
    shape = grid or grid_for([live])
    cell, levels = shape
    grid = [*keys, "_lv", "_cx", "_cy"]
    kept: DataFrame | None = None
    while True:
        cells = on_cells(live, cell, levels)
        own = cells.filter("_lv = _own").drop("_own").withColumn("_cells", cell_count(cell, levels))
        listed = top_k(own, grid, [F.col("_ord")], width, rank="_place")
        # A row may be kept this round only if every one of its cells lists it.
        seen = Window.partitionBy("_id")
        listed = materialize(listed.withColumn("_full", F.count(F.lit(1)).over(seen) == F.col("_cells")).drop("_cells"))
        ready, guests = listed.filter("_full").select("_id").distinct(), None
        if levels:
            guests = cells.filter("_lv > _own").drop("_own")
            ends = listed.filter(F.col("_place") >= width).groupBy(*grid).agg(F.max("_ord").alias("_end"))
            blind = guests.join(ends, grid).filter(F.col("_ord") > F.col("_end")).select("_id").distinct()
            ready = materialize(ready.join(blind, "_id", "left_anti"))
        edges = materialize(_edges(listed, guests, ready, keys, clash))
        count, lost, done = edges.count(), [], [listed, ready, edges]
        while count:
            beaten = _beaten(edges)
            lost.append(beaten)
            edges = materialize(edges.join(beaten, "loser", "left_anti")
                                .join(beaten.withColumnRenamed("loser", "winner"), "winner", "left_anti"))
            done.append(edges)
            before, count = count, edges.count()
            if count == before:
                break
        lost.append(edges.select("loser"))
        out = lost[0]
        for part in lost[1:]:
            out = out.union(part)
        fresh = materialize(ready.join(out.withColumnRenamed("loser", "_id"), "_id", "left_anti"))
        kept = fresh if kept is None else kept.union(fresh)
        complete = listed.filter(F.col("_place") >= width).isEmpty()
        discard(*done)
        if complete:
            break  # no list was cut, so every row has been decided
        undecided = live.join(fresh, "_id", "left_anti")
        dropped = overlap_join(undecided, live.join(fresh, "_id", "left_semi"), keys,
                               clash(suffixed("a"), suffixed("b")), grid=shape)
        rest = materialize(undecided.join(dropped.select(F.col("_id_a").alias("_id")).distinct(), "_id", "left_anti"))
        discard(live)
        live = rest
        if live.isEmpty():
            break
    discard(live)
    return kept.select(F.col("_id").alias(ident))


def nms(df: DataFrame, iou_threshold: float = 0.5, limit: int | None = None, *, scene: str = "scene_id",
        category: str = "category", ident: str = "det_id", width: int = WIDTH, grid: Grid | None = None) -> DataFrame:
    """Kept rows: confidence descending, then ``seq``; overlap strictly above the threshold suppresses.

    ``limit`` keeps the first rows per scene over all categories.
    """
    if not 0 < iou_threshold < 1:
        raise ValueError("iou_threshold must lie between 0 and 1")
    order = [-F.col("confidence"), F.col("seq")]
    keys = [scene, category]
    unique = first_per(df.select(*keys, ident, "seq", "confidence", *"xywh"), [*keys, *"xywh"], order)
    kept = independent_rows(unique, keys, order, ident, lambda a, b: iou(a, b) > iou_threshold, width=width, grid=grid or grid_for([df]))
    out = df.join(kept, ident, "left_semi")
    return out if limit is None else top_k(out, [scene], order, limit)


def valid_detections(df: DataFrame, width: Column, height: Column, threshold: float) -> DataFrame:
    """Finite corner boxes with an accepted score, clipped to the scene as integer boxes."""
    corners = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    finite = F.lit(True)
    for c in [*corners, F.col("confidence")]:
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    clip = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), top.cast("double"))
    x0, y0 = F.floor(clip(corners[0], width)), F.floor(clip(corners[1], height))
    x1, y1 = F.ceil(clip(corners[2], width)), F.ceil(clip(corners[3], height))
    good = (finite & F.col("category").isNotNull() & F.col("confidence").between(threshold, 1.0)
            & (corners[2] > corners[0]) & (corners[3] > corners[1]))
    return (df.filter(good).withColumn("x", x0).withColumn("y", y0).withColumn("w", x1 - x0).withColumn("h", y1 - y0)
            .filter((F.col("w") > 0) & (F.col("h") > 0)).drop("x0", "y0", "x1", "y1"))
