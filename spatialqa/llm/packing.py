"""Bounded-space online packing of token ids into sequences.

Each partition keeps a fixed number of open windows. A piece goes to the window it fits
best; when none has room, the fullest is emitted, its last gap filled with the head of the
piece. What is still open at the end of a partition is written with its ids and merged in
rounds, ``MERGE`` partitions at a time, by the same rule.
"""
from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from typing import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from spatialqa.llm.common import Writer, fields, materialize, slices, text_of
from spatialqa.llm.tokens import WordTokens

SIZE, OPEN, MERGE, LEAST = 4096, 64, 64, 32
END = 2
PIECES = fields("doc_id long,start long,length long,ids_crc32 long,doc_tokens long,sequence_id long,offset long,ids binary,part long")


class Windows:
    """The open windows of one task; hands out finished pieces as rows of PIECES."""

    def __init__(self, size: int, most: int, first_id: int) -> None:
        self.size, self.most, self.next_id = size, most, first_id
        self.gaps: list[tuple[int, int]] = []  # (room left, window), ascending
        self.pieces: dict[int, list[tuple]] = {}

    def put(self, window: int, gap: int, piece: tuple) -> None:
        self.pieces[window].append(piece)
        insort(self.gaps, (gap - len(piece[2]) // 4, window))

    def rows(self, window: int) -> Iterator[tuple]:
        """Offsets run without a gap from 0."""
        offset = 0
        for doc, start, ids, total in self.pieces.pop(window):
            yield doc, start, len(ids) // 4, zlib.crc32(ids), total, self.next_id, offset, None, None
            offset += len(ids) // 4
        self.next_id += 1

    def add(self, doc: int | None, start: int, ids: bytes, total: int) -> Iterator[tuple]:
        while len(ids) >= 4 * self.size:  # a whole sequence of one document
            self.pieces[-1] = [(doc, start, ids[:4 * self.size], total)]
            yield from self.rows(-1)
            start, ids = start + self.size, ids[4 * self.size:]
        while ids:
            best = bisect_left(self.gaps, (len(ids) // 4, -1))
            if best < len(self.gaps):
                gap, window = self.gaps.pop(best)
                self.put(window, gap, (doc, start, ids, total))
                if self.gaps[0][0] == 0:
                    yield from self.rows(self.gaps.pop(0)[1])
                return
            if len(self.gaps) < self.most:
                window = max(self.pieces, default=-1) + 1
                self.pieces[window] = []
                self.put(window, self.size, (doc, start, ids, total))
                return
            gap, window = self.gaps.pop(0)
            if gap >= LEAST and len(ids) // 4 - gap >= LEAST:
                self.pieces[window].append((doc, start, ids[:4 * gap], total))
                start, ids = start + gap, ids[4 * gap:]
            yield from self.rows(window)

    def left(self, part: int) -> Iterator[tuple]:
        """The pieces of open windows, with their ids, for the next round."""
        for pieces in self.pieces.values():
            for doc, start, ids, total in pieces:
                yield doc, start, len(ids) // 4, zlib.crc32(ids), total, None, None, ids, part

    def close(self) -> Iterator[tuple]:
        """The last round: the emptiest windows are poured into the gaps of the others, then all are emitted."""
        while len(self.gaps) > 1:
            emptiest = self.gaps[-1]
            if self.size - emptiest[0] > sum(g for g, _ in self.gaps[:-1]):
                break
            self.gaps.pop()
            for doc, start, ids, total in self.pieces.pop(emptiest[1]):
                while ids:
                    gap, window = self.gaps.pop()  # the largest gap, so that few pieces are cut
                    self.pieces[window].append((doc, start, ids[:4 * gap], total))
                    rest = ids[4 * gap:]
                    if gap * 4 > len(ids):
                        insort(self.gaps, (gap - len(ids) // 4, window))
                    start, ids = start + min(gap, len(ids) // 4), rest
        for window in list(self.pieces):
            yield from self.rows(window)


def pack(docs: DataFrame, tokens: Callable[[], Callable[[str], bytes]], size: int = SIZE, windows: int = OPEN, end: int | None = END) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents.

    ``tokens()`` gives a function from a text to packed little-endian 32-bit ids; ``end`` is
    put behind each document. A null text counts as empty, so with ``end`` each row gives at
    least one piece and without it an empty text gives none. Repeated rows and null ids are
    packed row by row. A text of any length is cut into whole sequences and one rest.
    Other columns of ``docs`` are not read. A task holds at most ``windows`` sequences; what
    all tasks leave open is at most that many sequences a partition.
    """
    tail = b"" if end is None else end.to_bytes(4, "little")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = tokens(), TaskContext.get().partitionId()
        space, out = Windows(size, windows, part << 32), Writer(PIECES)
        for batch in batches:
            for piece in slices(batch):
                for doc, text in zip(*[c.to_pylist() for c in piece.columns]):
                    ids = encode(text) + tail
                    for row in space.add(doc, 0, ids, len(ids) // 4):
                        if (full := out.add(row)) is not None:
                            yield full
        for row in space.left(part):
            if (full := out.add(row)) is not None:
                yield full
        if (rest := out.rest()) is not None:
            yield rest

    def again(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, space, group = Writer(PIECES), None, None

            def finish() -> Iterator[tuple]:
                return iter(()) if space is None else space.close() if last else space.left(group)

            for batch in batches:
                for piece in slices(batch):
                    for doc, start, _, _, total, _, _, ids, part in zip(*[c.to_pylist() for c in piece.columns]):
                        rows: list[tuple] = []
                        if part != group:
                            rows += finish()
                            group, space = part, Windows(size, 4 * windows, (level << 58) + (part << 32))
                        rows += space.add(doc, start, ids, total)
                        for row in rows:
                            if (full := out.add(row)) is not None:
                                yield full
            for row in finish():
                if (full := out.add(row)) is not None:
                    yield full
            if (rest := out.rest()) is not None:
                yield rest
        return run

    level, done = 1, []
    packed = materialize(docs.select("doc_id", text_of().alias("text")).mapInArrow(first, PIECES))
    while True:
        done.append(packed.where(F.col("sequence_id").isNotNull()))
        left = packed.where(F.col("sequence_id").isNull())
        parts = (left.agg(F.max("part")).first()[0] or 0) + 1
        groups = -(-parts // MERGE)
        grouped = (left.withColumn("part", F.expr(f"part div {MERGE}")).repartition(groups, "part")
                   .sortWithinPartitions("part", F.xxhash64("doc_id", "start"), "doc_id", "start", "ids_crc32"))
        packed = grouped.mapInArrow(again(level, groups == 1), PIECES)
        if groups == 1:
            break
        packed, level = materialize(packed), level + 1
    out = packed
    for frame in done:
        out = out.unionByName(frame)
    return out.drop("ids", "part")


def pack_words(docs: DataFrame, path: str, size: int = SIZE, windows: int = OPEN) -> DataFrame:
    """``pack`` with the tokenizer of words with ends at ``path``."""
    return pack(docs, lambda: WordTokens(path), size, windows)
