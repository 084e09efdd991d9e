"""Connected components of a table of links, by rounds of star contraction."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spatialqa.llm.common import discard, materialize
from spatialqa.session import packed_rows


def components(links: DataFrame) -> DataFrame:
    """(id, component): for each end of a link (columns a, b) the smallest id it can reach.

    Each round points all neighbours of a node to the smallest of them, first the larger
    neighbours, then the smaller ones; it ends when nothing changes. Every round is a
    written table that replaces the one before; the minimum of a node is a partial aggregate and its join can be
    split, so a node with very many links is no bottleneck. No links: no rows.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = packed_rows(both).join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = packed_rows(large).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        contracted = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        discard(edges)
        edges = contracted
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component")).groupBy("id").agg(F.min("component").alias("component"))
