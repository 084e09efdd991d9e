"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors are rotated and split into blocks of ``BLOCK`` dimensions. Two vectors whose
squared distance is at most D differ in some block by at most that block's share of D,
in proportion to its dimensions. Each block is range-joined on a grid: a vector lies in one
cell and asks all cells within the block's radius. What shares a cell is thinned by a bound
from vectors rounded to 8 bits that never loses a link, and confirmed by cosine.
"""
from __future__ import annotations

import hashlib
from itertools import product
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spatialqa.llm.common import Writer, fields, flat_map, materialize, slices
from spatialqa.llm.graph import components

COSINE, BLOCK, SIDE, STEPS = 0.98, 4, 4.0, 127
#: Vectors of one cell that a task holds at once; a fuller cell is dealt over several groups.
HELD = 4000


def rotation(n: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(n).standard_normal((n, n)))
    return q * np.sign(np.diag(r))


def unit(vector: bytes) -> np.ndarray:
    v = np.frombuffer(vector, np.float64)
    v = v / np.abs(v).max()
    return v / np.sqrt(v @ v)


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id, a print of label and values, and the values as doubles; the last two are null for what links with nothing."""
    def start() -> Callable[..., Iterator[tuple]]:
        def one(i: int | None, label, values: list | None) -> Iterator[tuple]:
            good = i is not None and label is not None and values and all(x is not None for x in values)
            v = np.array(values, np.float64) + 0.0 if good else None
            if v is None or not np.isfinite(v).all() or not v.any():
                yield i, None, None
            else:
                yield i, hashlib.blake2b(f"{label} {len(v)} ".encode() + v.tobytes(), digest_size=16).digest(), v.tobytes()
        return one

    return flat_map(vectors, start, fields("vec_id long,print binary,vec binary"))


def cells(reps: DataFrame, cosine: float) -> DataFrame:
    """key of (label, block, cell), whether the row asks or lies there, rep, the rotated vector in 8 bits."""
    budget = 2 - 2 * cosine

    def start() -> Callable[..., Iterator[tuple]]:
        import xxhash
        turned: dict[int, np.ndarray] = {}

        def one(label: str, rep: int, vec: bytes) -> Iterator[tuple]:
            n = len(vec) // 8
            if n not in turned:
                turned[n] = rotation(n)
            v = turned[n] @ unit(vec)
            rounded = np.rint(v * STEPS).astype(np.int8).tobytes()
            for first in range(0, n, BLOCK):
                x = v[first:first + BLOCK]
                radius = np.sqrt(budget * len(x) / n) + 1e-9
                side = SIDE * radius
                head = f"{label} {n} {first} "
                name = lambda cell: xxhash.xxh3_64_intdigest(head + repr(cell)) - (1 << 63)  # noqa: B023, E731
                yield name(tuple(np.floor(x / side).astype(int).tolist())), False, rep, rounded
                spans = [range(a, b + 1) for a, b in zip(np.floor((x - radius) / side).astype(int).tolist(), np.floor((x + radius) / side).astype(int).tolist())]
                for cell in product(*spans):
                    yield name(cell), True, rep, rounded
        return one

    return flat_map(reps, start, fields("key long,asks boolean,rep long,rounded binary"))


def meet(rows: DataFrame, cosine: float) -> DataFrame:
    """Pairs a < b that share a cell and may be near enough. ``rows`` (key, salt, asks, rep, rounded) comes sorted."""
    schema = fields("a long,b long")

    def near(held: list, asked: list) -> Iterator[tuple]:
        if not held or not asked:
            return
        by_size: dict[int, tuple[list, list]] = {}
        for side, rows_ in enumerate((held, asked)):
            for rep, v in rows_:
                by_size.setdefault(len(v), ([], []))[side].append((rep, v))
        for n, (x, y) in by_size.items():
            if x and y:
                ids, others = np.array([r for r, _ in x]), np.array([r for r, _ in y])
                a = np.frombuffer(b"".join(v for _, v in x), np.int8).reshape(-1, n).astype(np.float32)
                b = np.frombuffer(b"".join(v for _, v in y), np.int8).reshape(-1, n).astype(np.float32)
                squared = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
                most = STEPS * np.sqrt(2 - 2 * cosine) + np.sqrt(n) + 0.01  # half a step of rounding in each coordinate of both
                i, j = np.nonzero((squared <= most * most) & (ids[:, None] < others[None, :]))
                yield from zip(ids[i].tolist(), others[j].tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, group, held, asked = Writer(schema), None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            for pair in near(held, asked):
                if (full := out.add(pair)) is not None:
                    yield full
            asked.clear()

        for batch in batches:
            for part in slices(batch):
                for key, salt, asks, rep, rounded in zip(*[c.to_pylist() for c in part.columns]):
                    if (key, salt) != group:
                        yield from flush()
                        group = (key, salt)
                        held.clear()
                    (asked if asks else held).append((rep, rounded))
                    if len(asked) >= 1000:
                        yield from flush()
        yield from flush()
        if (rest := out.rest()) is not None:
            yield rest

    return rows.mapInArrow(run, schema)


def confirmed(pairs: DataFrame, reps: DataFrame, cosine: float) -> DataFrame:
    def start() -> Callable[..., Iterator[tuple]]:
        def one(a: int, b: int, x: bytes, y: bytes) -> Iterator[tuple]:
            p, q = np.frombuffer(x, np.float64), np.frombuffer(y, np.float64)
            p, q = p / np.abs(p).max(), q / np.abs(q).max()
            if float(p @ q) / (np.sqrt(p @ p) * np.sqrt(q @ q)) >= cosine:
                yield a, b
        return one

    x, y = reps.select(F.col("rep").alias("a"), F.col("vec").alias("x")), reps.select(F.col("rep").alias("b"), F.col("vec").alias("y"))
    return flat_map(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y"), start, fields("a long,b long"))


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``vectors`` (vec_id, label, embedding).

    Only vectors of one label and one length are compared. A null label, a null, empty or
    zero vector, one with null or non-finite components, and a null id link with nothing.
    Equal vectors collapse before any pair is made; each counts as a link of the others.
    Rows that share an id count once each.
    """
    all_ = materialize(prepared(vectors.select("vec_id", F.col("label").cast("string"), "embedding")))
    label = vectors.select(F.col("vec_id").alias("rep"), F.col("label").cast("string").alias("label")).where("rep is not null and label is not null").dropDuplicates(["rep", "label"])
    reps = materialize(all_.where("print is not null").groupBy("print").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.min("vec").alias("vec")))
    rows = materialize(cells(reps.join(label, "rep").select("label", "rep", "vec"), cosine))
    full = rows.where("not asks").groupBy("key").count().where(F.col("count") > HELD).select("key", F.ceil(F.col("count") / HELD).cast("int").alias("parts"))
    dealt = rows.join(full, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    one = F.array(F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("salt", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(one)))
    sorted_ = dealt.select("key", "salt", "asks", "rep", "rounded").repartition("key", "salt").sortWithinPartitions("key", "salt", "asks", "rep")
    links = materialize(confirmed(meet(sorted_, cosine).distinct(), reps, cosine))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = reps.select(F.col("rep").alias("b"), "size")
    counts = both.join(sizes, "b").groupBy("a").agg(F.sum("size").alias("others"))
    found = components(links)
    classes = (reps.join(counts, reps.rep == counts.a, "left").join(found, reps.rep == found.id, "left")
               .select(F.col("print").alias("p"), (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c")))
    out = all_.join(classes, all_.print == classes.p, "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
