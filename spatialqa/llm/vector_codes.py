"""Vector code compression: product codes learned by a dual-tree Lloyd iteration.

Vectors become integers and are cut into ``PARTS`` parts. A block of vectors and the codebook
of a part are both trees of boxes. Pairs of nodes are bounded by the distance of their boxes:
an entry node goes where even its nearest corner is farther than another's farthest. A node
of parts with one entry left is assigned whole, with its cached sum; parts of leaves that
stay uncertain compare integer distances. A round's sums of all blocks give the next entries.
"""
from __future__ import annotations

import hashlib
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spatialqa.llm.common import Writer, arrow_types, fields, materialize, slices

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components beyond this size count as it, so that all sums are exact in 64 bits.
LARGEST = float(1 << 16)
#: Vectors of a block, parts of a leaf.
HELD, LEAF = 4096, 16
FAR = np.iinfo(np.int64).max


def integers(values: list[float]) -> np.ndarray:
    return np.floor(np.clip(np.asarray(values, np.float64), -LARGEST, LARGEST) * SCALE).astype(np.int64)


class Boxes:
    """A balanced binary tree over the rows of ``points``, split at the median of the widest side.

    ``order`` lists the rows so that a node is a slice of it; level l has 2 ** l nodes with
    ``bounds[l]`` (2 ** l + 1 offsets), ``low[l]`` and ``high[l]``. Depth ends when nodes have
    ``leaf`` rows or fewer.
    """

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        order = np.arange(len(points))
        self.bounds, self.low, self.high = [], [], []
        bounds = np.array([0, len(points)])
        while True:
            held = points[order]
            low, high = (f.reduceat(held, bounds[:-1], axis=0) for f in (np.minimum, np.maximum))
            self.bounds.append(bounds)
            self.low.append(low)
            self.high.append(high)
            sizes = np.diff(bounds)
            if sizes.max() <= leaf or sizes.min() < 2:
                break
            node = np.repeat(np.arange(len(sizes)), sizes)
            side = np.argmax(high - low, axis=1)
            order = order[np.lexsort((order, held[np.arange(len(order)), side[node]], node))]
            cuts = bounds[:-1] + (sizes + 1) // 2
            bounds = np.sort(np.concatenate([bounds, cuts]))
        self.order = order

    @property
    def depth(self) -> int:
        return len(self.bounds) - 1


def box_distances(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest squared distance that rows of one box can have to rows of the other."""
    gap = np.maximum(np.maximum(low - other_high, other_low - high), 0)
    reach = np.maximum(high - other_low, other_high - low)
    return (gap * gap).sum(axis=1), (reach * reach).sum(axis=1)


def assign(points: np.ndarray, book: np.ndarray, sums: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The nearest row of ``book`` for each row of ``points``, the lowest index where several are.

    ``sums`` (entry sums, entry counts) get the assigned rows added: whole nodes by their
    cached sum, the others one by one.
    """
    code = np.full(len(points), -1, np.int64)
    if not len(points):
        return code
    tree, entries = Boxes(points, LEAF), Boxes(book, 1)
    cached = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[tree.order], axis=0)])
    level = {"p": 0, "e": 0}
    left, right = np.zeros(1, np.int64), np.zeros(1, np.int64)
    uncertain: list[tuple[int, int, np.ndarray]] = []

    def whole(start: int, end: int, entry: int) -> None:
        code[tree.order[start:end]] = entry
        if sums:
            sums[0][entry] += cached[end] - cached[start]
            sums[1][entry] += end - start

    while len(left):
        p, e = level["p"], level["e"]
        nearest, farthest = box_distances(tree.low[p][left], tree.high[p][left], entries.low[e][right], entries.high[e][right])
        most = np.full(len(tree.low[p]), FAR)
        np.minimum.at(most, left, farthest)
        fits = nearest <= most[left]
        left, right = left[fits], right[fits]
        if e == entries.depth:
            single = np.diff(entries.bounds[e])[right] == 1
            alone = (np.bincount(left, minlength=len(most))[left] == 1) & single
            for node, entry in zip(left[alone].tolist(), right[alone].tolist()):
                whole(int(tree.bounds[p][node]), int(tree.bounds[p][node + 1]), int(entries.order[entries.bounds[e][entry]]))
            left, right = left[~alone], right[~alone]
            if p == tree.depth:
                cuts = np.flatnonzero(np.diff(left)) + 1 if len(left) else []
                for node, group in zip(left[np.r_[0, cuts].astype(int)].tolist() if len(left) else (), np.split(right, cuts)):
                    held = np.concatenate([entries.order[entries.bounds[e][x]:entries.bounds[e][x + 1]] for x in group.tolist()])
                    uncertain.append((int(tree.bounds[p][node]), int(tree.bounds[p][node + 1]), np.sort(held)))
                break
        if p < tree.depth:
            left, right, level["p"] = np.repeat(2 * left, 2), np.repeat(right, 2), p + 1
            left[1::2] += 1
        if e < entries.depth:
            left, right, level["e"] = np.repeat(left, 2), np.repeat(2 * right, 2), e + 1
            right[1::2] += 1
        by_node = np.lexsort((right, left))
        left, right = left[by_node], right[by_node]
    for start, end, held in uncertain:
        rows = tree.order[start:end]
        difference = points[rows][:, None, :] - book[held][None, :, :]
        best = held[np.argmin((difference * difference).sum(axis=2), axis=1)]  # held rises, so ties go to the lowest
        code[rows] = best
        if sums:
            np.add.at(sums[0], best, points[rows])
            np.add.at(sums[1], best, 1)
    return code


def good(vectors: DataFrame) -> DataFrame:
    """Rows with a vector that has neither null nor non-finite components, as doubles ``v``."""
    v = F.col("embedding").cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & ~odd).select("vec_id", "label", v.alias("v"))


def padded(values: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(values), width), np.int64)
    for i, v in enumerate(values):
        out[i, :len(v)] = v
    return out


def blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of at most HELD rows with their vectors (last column) as integers."""
    for batch in batches:
        for part in slices(batch):
            for start in range(0, part.num_rows, HELD):
                piece = part.slice(start, HELD)
                column = piece.column(piece.num_columns - 1)
                sizes = np.diff(column.offsets.to_numpy())
                if (sizes == width).all():
                    yield piece, integers(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)
                else:
                    yield piece, padded([integers(x) for x in column.to_pylist()], width)


def totals(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, n and the component sums s0, s1, ... of the parts nearest to each entry; each task adds its own first."""
    parts, entries, side = books.shape
    schema = fields("part int,entry int,n long," + ",".join(f"s{i} long" for i in range(side)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for _, held in blocks(batches, parts * side):
            for p in range(parts):
                assign(np.ascontiguousarray(held[:, p * side:(p + 1) * side]), books[p], (sums[p], counts[p]))
        out = Writer(schema)
        for p, e in zip(*(x.tolist() for x in np.nonzero(counts))):
            if (full := out.add((p, e, int(counts[p, e]), *sums[p, e].tolist()))) is not None:
                yield full
        if (rest := out.rest()) is not None:
            yield rest

    added = rows.select("v").mapInArrow(run, schema).groupBy("part", "entry")
    return added.agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(side)])


def learn(rows: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, parts: int = PARTS) -> np.ndarray:
    """Codebooks (part, entry, component); fewer entries where there are fewer rows. The driver sees the first vectors and a round's sums, both bounded by the codebooks' size."""
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    side = max(1, -(-width // parts))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    start = padded([integers(r.v) for r in first], parts * side)
    books = np.ascontiguousarray(start.reshape(-1, parts, side).transpose(1, 0, 2))
    for _ in range(rounds if first else 0):
        new = books.copy()
        for p, e, n, *sums in totals(rows, books).collect():
            new[p, e] = np.array(sums, np.int64) // n
        books = new
    return books


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of each row."""
    parts, _, side = books.shape
    label = rows.schema["label"]
    schema = fields("vec_id long,code string,error long")
    schema = type(schema)([schema["vec_id"], label, schema["code"], schema["error"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = arrow_types(schema)
        for batch, held in blocks(batches, parts * side):
            codes, errors = np.zeros((len(held), parts), np.uint8), np.zeros(len(held), np.int64)
            for p in range(parts):
                points = np.ascontiguousarray(held[:, p * side:(p + 1) * side])
                code = assign(points, books[p])
                codes[:, p] = code
                errors += ((points - books[p][code]) ** 2).sum(axis=1)
            names = [row.tobytes().hex() for row in codes]
            columns = [batch.column(0), batch.column(1), pa.array(names, types[2]), pa.array(errors, types[3])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.select(F.col("vec_id").cast("long"), "label", "v").mapInArrow(run, schema)


def digest(books: np.ndarray) -> str:
    """All components by part, entry and position, as text."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each vector of ``vectors`` (vec_id, label, embedding).

    A null vector and one with null or non-finite components have no row. Vectors shorter than
    the longest, and a length that ``PARTS`` does not divide, count as filled with zeros;
    components beyond +-``LARGEST`` count as that. Repeated ids are rows of their own, in the
    order of their vectors where they start a codebook; a null id comes last. With fewer than
    ``ENTRIES`` rows there are that many entries, equal ones among them: the lowest is taken.
    Null labels are one label. An empty table gives no rows. Other columns are not read.
    """
    rows = good(vectors)
    books = learn(rows)
    if not books.shape[1]:
        books = np.zeros((PARTS, 1, 1), np.int64)
    codes = materialize(encoded(rows, books))
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("of"), "label_error")
    return codes.join(sums, codes.label.eqNullSafe(sums.of)).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
