"""Ranking and running totals that stay parallel when one key holds most rows."""
from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

SALTS = 32
NATIVE_LIMIT = 1000  # spark.sql.optimizer.windowGroupLimitThreshold


def first_per(df: DataFrame, keys: list[str], order: list[Column], columns: list[str] | None = None) -> DataFrame:
    """First row of each key by ``order``; a partial aggregate, so a hot key is combined map-side."""
    rest = [c for c in (columns or df.columns) if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    best = F.min_by(F.struct(*rest), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order))))
    return df.groupBy(*keys).agg(best.alias("_first")).select(*keys, "_first.*")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int | None, rank: str | None = None) -> DataFrame:
    """First ``k`` rows of each key, all of them when ``k`` is None.

    Up to ``NATIVE_LIMIT`` Spark itself cuts each map task's share of a key to ``k`` rows
    before the shuffle. Above it a first cut over (key, salt) does the same.
    """
    name = rank or "_rank"
    number = lambda *cols: F.row_number().over(Window.partitionBy(*cols).orderBy(*order))
    if k is None:
        return df.withColumn(name, number(*keys)) if rank else df
    cut = df
    if k > NATIVE_LIMIT:
        cut = (df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
               .withColumn("_cut", number(*keys, "_salt")).filter(F.col("_cut") <= k).drop("_cut", "_salt"))
    out = cut.withColumn(name, number(*keys)).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def order_ranges(df: DataFrame, order: str, ranges: int | None = None) -> list:
    """Upper ends of ranges of ``order`` with about as many rows each; by default one range for each shuffle partition.

    A sketch of the column, built in the tasks; the driver sees one value a range.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = df.agg(F.percentile_approx(order, [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else None
    return sorted(set(ends or []))


def _range_of(order: Column, ends: list, first: int = 0) -> Column:
    """Number of the range a value lies in, by halving."""
    if not ends:
        return F.lit(first)
    middle = len(ends) // 2
    return F.when(order > ends[middle], _range_of(order, ends[middle + 1:], first + middle + 1)).otherwise(_range_of(order, ends[:middle], first))


def running(df: DataFrame, keys: list[str], order: str, aggs: dict[str, tuple[str, Column]],
            exclusive: Iterable[str] = (), ends: list | None = None) -> DataFrame:
    """Running ``sum`` / ``count`` / ``max`` per key along an ``order`` column, as a prefix scan.

    The order is cut into ranges of about equal row counts (``ends``; see ``order_ranges``), so
    a key that holds most rows is spread over all of them. Rows are shuffled once, by (key,
    range); windows run in there, and each range adds the combined total of those before it, of
    which a key has no more than there are ranges. ``exclusive`` names results that leave out
    the current row (sum starts at 0). A null order counts as lying in the first range.
    """
    kinds, merge = {"sum": F.sum, "count": F.count, "max": F.max}, {"sum": "sum", "count": "sum", "max": "max"}
    exclusive, at = set(exclusive), "_range"
    cut = df.withColumn(at, _range_of(F.col(order), order_ranges(df, order) if ends is None else ends))
    for name, (_, expr) in aggs.items():
        cut = cut.withColumn(f"_in_{name}", expr)
    totals = cut.groupBy(*keys, at).agg(*(kinds[kind](f"_in_{name}").alias(f"_tot_{name}") for name, (kind, _) in aggs.items()))
    before = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    prefix = totals.select(*keys, at, *(kinds[merge[kind]](f"_tot_{name}").over(before).alias(f"_pre_{name}") for name, (kind, _) in aggs.items()))
    base = Window.partitionBy(*keys, at).orderBy(order)
    for name, (kind, _) in aggs.items():
        frame = base.rowsBetween(Window.unboundedPreceding, -1 if name in exclusive else 0)
        cut = cut.withColumn(f"_own_{name}", kinds[kind](f"_in_{name}").over(frame))
    out = cut.join(prefix, [*keys, at])
    for name, (kind, _) in aggs.items():
        own, pre = F.col(f"_own_{name}"), F.col(f"_pre_{name}")
        out = out.withColumn(name, F.greatest(own, pre) if kind == "max" else F.coalesce(own, F.lit(0)) + F.coalesce(pre, F.lit(0)))
    return out.drop(at, *(f"_{part}_{n}" for n in aggs for part in ("in", "own", "pre")))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Later record replaces the earlier one; with ``order`` the first position is kept."""
    rest = [c for c in old.columns if c not in keys and c != order]
    left = old.select(*keys, F.struct(*rest).alias("_old"), *([F.col(order).alias("_oo")] if order else []))
    right = new.select(*keys, F.struct(*rest).alias("_new"), *([F.col(order).alias("_no")] if order else []))
    joined = left.join(right, keys, "full_outer").withColumn("_row", F.coalesce("_new", "_old"))
    place = [F.coalesce("_oo", "_no").alias(order)] if order else []
    return joined.select(*keys, "_row.*", *place).select(*old.columns)
