"""Box overlap join as an equi-join on grid cells."""
from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from spatialqa.functions.boxes import Box, overlaps
from spatialqa.session import unfolded

CELL = 256
MAX_CELLS = 64      # cells per box on its own level
GROWTH = 4          # each level has cells this much larger
HOT = 50_000        # rows of one cell before the cell is split


def _level(box: Box, cell: int) -> Column:
    """Coarsest grid needed so that the box touches at most about ``MAX_CELLS`` cells."""
    side = F.greatest(box.w, box.h).cast("double")
    span = cell * (MAX_CELLS ** 0.5 - 1)
    return F.greatest(F.lit(0), F.ceil(F.log(F.greatest(side, F.lit(1.0)) / span) / F.log(F.lit(float(GROWTH))))).cast("int")


class Grid(NamedTuple):
    """Cell side of the finest grid and the number of coarser grids above it."""
    cell: int
    levels: int


def grid_for(frames: list[DataFrame], cell: int | None = None) -> Grid:
    """Grid fitted to the boxes: cells of about three quarters of the median box side, which a few huge boxes don't move.

    One small aggregate over box sides. Levels above 0 exist only when some box is far
    larger than a cell.
    """
    side = F.greatest("w", "h").cast("double")
    sides = [df.select(side.alias("s")) for df in frames]
    union = sides[0]
    for other in sides[1:]:
        union = union.unionAll(other)
    row = union.agg(F.percentile_approx("s", 0.5).alias("middle"), F.max("s").alias("top")).first()
    if row["middle"] is None:
        return Grid(cell or CELL, 0)
    cell = cell or max(16, 16 * round(row["middle"] * 0.75 / 16))
    reach = cell * (MAX_CELLS ** 0.5 - 1)
    levels = max(0, math.ceil(math.log(max(row["top"], 1.0) / reach, GROWTH) - 1e-9))
    return Grid(cell, levels)


def on_cells(df: DataFrame, cell: int = CELL, levels: int = 0) -> DataFrame:
    """One row per grid cell a box touches, on its own level and every coarser one."""
    box = Box.of()
    out = df.withColumn("_own", _level(box, cell) if levels else F.lit(0))
    if levels:
        out = out.withColumn("_lv", F.explode(F.sequence("_own", F.lit(levels))))
        size = (F.lit(cell) * F.pow(F.lit(GROWTH), F.col("_lv"))).cast("bigint")
    else:
        out = out.withColumn("_lv", F.lit(0))
        size = F.lit(cell).cast("bigint")
    first = lambda v: F.floor(v / size).cast("bigint")
    return (out.withColumn("_cx", F.explode(F.sequence(first(box.x), first(box.right - 1))))
            .withColumn("_cy", F.explode(F.sequence(first(box.y), first(box.bottom - 1)))))


def cell_count(cell: int = CELL, levels: int = 0) -> Column:
    """Number of cells a box touches on its own level."""
    box = Box.of()
    level = _level(box, cell) if levels else F.lit(0)
    size = (F.lit(cell) * F.pow(F.lit(GROWTH), level)).cast("bigint")
    axis = lambda lo, hi: F.floor((hi - 1) / size) - F.floor(lo / size) + 1
    return (axis(box.x, box.right) * axis(box.y, box.bottom)).cast("bigint")


def _meeting(cells: DataFrame, guest: int) -> DataFrame:
    """Kinds of meetings a row takes part in: 0 both lie on this level, 1 side b is the guest, 2 side a is.

    ``guest`` is the kind in which this side is the guest.
    """
    host = F.array(F.lit(0), F.lit(3 - guest))
    return cells.withColumn("_kind", F.explode(F.when(F.col("_lv") == F.col("_own"), host).otherwise(F.array(F.lit(guest)))))


def _full_keys(df: DataFrame, keys: list[str], hot: int) -> DataFrame:
    """Keys with more than ``hot`` rows; no cell of another key is crowded, as a box is in a cell once."""
    return df.groupBy(*keys).count().filter(F.col("count") > hot).select(*keys)


def _within(cells: DataFrame, full: DataFrame, keys: list[str]) -> DataFrame:
    return cells.join(F.broadcast(full), keys, "left_semi") if keys else cells


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], condition: Column | None = None, *,
                 grid: Grid | None = None, cell: int | None = None, hot: int = HOT) -> DataFrame:
    """Pairs of overlapping boxes with equal ``keys``; columns end in ``_a`` and ``_b``.

    Both inputs carry ``x, y, w, h``. Every pair is produced once, in the cell holding
    the top-left corner of the intersection. Boxes far larger than a cell lie on a
    coarser grid, where smaller ones are guests: guests meet the boxes that lie there,
    never each other, so one huge box adds about one candidate for each box under it. A
    cell holding more than ``hot`` rows is split: one side is dealt out over salts, the
    other is repeated for each of them (plan only). ``condition`` may refer to the
    suffixed columns and is applied inside the join. The result lists every pair of a
    crowd; that is its purpose.
    """
    cell, levels = grid or grid_for([a, b], cell)
    grid = [*keys, "_lv", "_cx", "_cy", "_kind"]
    left, right = _meeting(on_cells(a, cell, levels), 2), _meeting(on_cells(b, cell, levels), 1)
    # Of each meeting the side that may hold many rows is dealt out: guests, else side a.
    full = _full_keys(a, keys, hot), _full_keys(b, keys, hot)
    counts = (_within(left.filter("_kind <> 1").select(*grid), full[0], keys).groupBy(*grid).count()
              .unionByName(_within(right.filter("_kind = 1").select(*grid), full[1], keys).groupBy(*grid).count()))
    # At most a row for each ``hot`` rows of the cells, so this side of the joins is small.
    crowded = F.broadcast(counts.filter(F.col("count") > hot).select(*grid, F.ceil(F.col("count") / hot).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    one, every = (lambda columns: F.array(F.pmod(F.xxhash64(*columns), parts).cast("int"))), F.sequence(F.lit(0), parts - 1)
    left = left.join(crowded, grid, "left").withColumn("_salt", F.explode(F.when(F.col("_kind") == 1, every).otherwise(one(a.columns)))).drop("_parts")
    right = right.join(crowded, grid, "left").withColumn("_salt", F.explode(F.when(F.col("_kind") == 1, one(b.columns)).otherwise(every))).drop("_parts")
    grid = [*grid, "_salt"]
    left = unfolded(left).select(*grid, *(F.col(c).alias(f"{c}_a") for c in [*a.columns, "_own"] if c not in keys))
    right = right.select(*grid, *(F.col(c).alias(f"{c}_b") for c in [*b.columns, "_own"] if c not in keys))
    ba, bb = (Box(*(F.col(f"{k}_{s}") for k in "xywh")) for s in "ab")
    size = (F.lit(cell) * F.pow(F.lit(GROWTH), F.col("_lv"))).cast("bigint") if levels else F.lit(cell).cast("bigint")
    home = ((F.floor(F.greatest(ba.x, bb.x) / size) == F.col("_cx"))
            & (F.floor(F.greatest(ba.y, bb.y) / size) == F.col("_cy")))
    if levels:
        home = home & (F.col("_lv") == F.greatest("_own_a", "_own_b"))
    test = overlaps(ba, bb) & home
    if condition is not None:
        test = test & condition
    return left.join(right, grid).filter(test).drop("_lv", "_cx", "_cy", "_kind", "_salt", "_own_a", "_own_b")


def suffixed(side: str) -> Box:
    """Box of one side of an ``overlap_join`` result."""
    return Box(*(F.col(f"{k}_{side}") for k in "xywh"))
