"""Back-to-front order under occlusion edges."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spatialqa.operators.ordered import running
from spatialqa.session import discard, materialize


def layer_order(items: DataFrame, edges: DataFrame, order: list[str], ident: str = "object_id", scene: str = "scene_id",
                position: bool = False) -> DataFrame:
    """Adds ``paint_order`` (comparable within a scene) and ``in_cycle``.

    ``edges(scene_id, front_id, back_id)``: the front item is painted after the back one.
    The order is that of repeatedly taking the first item, by ``order`` then id, that
    occludes no waiting item; items that can never be taken follow in key order.

    An item taken late comes right after the item that frees it, so its place is the
    largest key among itself and everything it waits for. Items freed at the same place
    repeat the question among themselves, which gives a path of keys that sorts like the
    sequential loop. Only items with edges take part in the rounds.
    """
    key = F.struct(*order, F.col(ident).alias("_key_id"))
    base = items.withColumn("_key", key)
    present = base.select(scene, ident)
    links = materialize(edges.select(scene, "front_id", "back_id").distinct()
                        .join(present.withColumnRenamed(ident, "front_id"), [scene, "front_id"], "left_semi")
                        .join(present.withColumnRenamed(ident, "back_id"), [scene, "back_id"], "left_semi"))
    if links.isEmpty():
        return _numbered(base.withColumn("paint_order", F.struct(F.lit(False).alias("in_cycle"), F.array("_key").alias("_path"))).withColumn("in_cycle", F.lit(False)).drop("_key"), scene, position)
    busy = links.select(scene, F.col("front_id").alias(ident)).union(links.select(scene, F.col("back_id").alias(ident))).distinct()
    nodes = materialize(base.join(busy, [scene, ident]).select(scene, F.col(ident).alias("_id"), "_key"))
    paths = nodes.select(scene, "_id", "_key", F.array().cast(f"array<{nodes.schema['_key'].dataType.simpleString()}>").alias("_path"))
    finished = None
    cyclic = None
    active, arcs = paths, links
    while not active.isEmpty():
        placed, stuck = _places(active, arcs, scene)
        if cyclic is None:
            cyclic = stuck
        grown = materialize(active.join(placed, [scene, "_id"]).withColumn("_path", F.concat("_path", F.array("_at"))))
        done = grown.filter(F.col("_at") == F.col("_key")).select(scene, "_id", "_path")
        finished = done if finished is None else finished.union(done)
        late = grown.filter(F.col("_at") != F.col("_key"))
        slot = late.select(scene, "_id", "_path")
        # Waiting inside a place matters only between items that share it.
        inner = materialize(arcs.join(slot.select(scene, F.col("_id").alias("front_id"), F.col("_path").alias("_pf")), [scene, "front_id"])
                            .join(slot.select(scene, F.col("_id").alias("back_id"), F.col("_path").alias("_pb")), [scene, "back_id"])
                            .filter(F.col("_pf") == F.col("_pb")).select(scene, "front_id", "back_id"))
        discard(arcs)
        arcs = inner
        active = late.drop("_at")
    out = base
    single = F.array("_key")
    if finished is None:
        out = out.withColumn("in_cycle", F.lit(False)).withColumn("_path", single)
    else:
        loops = cyclic.select(scene, F.col("_id").alias(ident), F.lit(True).alias("in_cycle"))
        out = (out.join(finished.withColumnRenamed("_id", ident), [scene, ident], "left").join(loops, [scene, ident], "left")
               .withColumn("in_cycle", F.coalesce("in_cycle", F.lit(False))).withColumn("_path", F.coalesce("_path", single)))
    return _numbered(out.withColumn("paint_order", F.struct("in_cycle", "_path")).drop("_path", "_key"), scene, position)


def _numbered(df: DataFrame, scene: str, position: bool) -> DataFrame:
    if not position:
        return df
    # A global range sort numbers the rows whatever the size of one scene.
    rows = materialize(df.orderBy(scene, "paint_order").withColumn("_at", F.monotonically_increasing_id()))
    return running(rows, [scene], "_at", {"position": ("count", F.lit(1))}, exclusive=["position"]).drop("_at")


def _places(nodes: DataFrame, arcs: DataFrame, scene: str) -> tuple[DataFrame, DataFrame]:
    """(place ``_at`` per item, items on or behind a cycle)."""
    waiting = arcs.select(scene, F.col("front_id").alias("_id")).distinct()
    ready = materialize(nodes.join(waiting, [scene, "_id"], "left_anti").select(scene, "_id", F.col("_key").alias("_at")))
    rest = materialize(nodes.join(waiting, [scene, "_id"], "left_semi").select(scene, "_id", "_key"))
    while not rest.isEmpty():
        need = arcs.join(ready.select(scene, F.col("_id").alias("back_id"), F.col("_at").alias("_b")), [scene, "back_id"], "left")
        state = need.groupBy(scene, F.col("front_id").alias("_id")).agg(F.max("_b").alias("_b"), F.max(F.col("_b").isNull()).alias("_open"))
        step = materialize(rest.join(state.filter(~F.col("_open")), [scene, "_id"]).select(scene, "_id", F.greatest("_key", "_b").alias("_at")))
        if step.isEmpty():
            break
        more, fewer = materialize(ready.union(step)), materialize(rest.join(step, [scene, "_id"], "left_anti"))
        discard(ready, rest, step)
        ready, rest = more, fewer
    return ready, rest.select(scene, "_id")
