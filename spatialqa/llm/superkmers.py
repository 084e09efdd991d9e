"""Substring dedup by super-k-mers of words.

A window is ``WINDOW`` consecutive words of one document. Its minimiser is the smallest hash
among the ``GRAM``-word sequences in it. Consecutive windows with one minimiser form a
super-k-mer, which travels as one packed string to the bucket of that minimiser, where the
windows are sorted and equal ones meet.

Only super-k-mers travel whose minimiser occurs in two documents; that is settled before on
headers without text. A minimiser under which very many windows fall is split further, by
the digest of each window, with aggregation before the shuffle; such windows meet in a
join that Spark can split.
"""
from __future__ import annotations

import hashlib
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spatialqa.llm.common import Writer, fields, flat_map, materialize, slices, squeezed, text_of

WINDOW, GRAM = 50, 8
#: The most windows of one super-k-mer, and the windows of one minimiser above which it is split by window (plan only).
LONGEST, HOT = 256, 20_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    """Words between bytes 20 and 09-0D: what bytes.split() parts at."""
    return text.split()


def super_kmers(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(minimiser, first window, windows) in order, covering each window of the document once."""
    if len(words) < WINDOW:
        return []
    import xxhash
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    grams = np.zeros(len(h) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        grams = grams * MIX + h[i:i + len(grams)]
    grams ^= grams >> np.uint64(29)
    grams *= MIX
    least, width, span = grams, 1, WINDOW - GRAM + 1
    while 2 * width <= span:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < span:
        least = np.minimum(least[:len(least) - (span - width)], least[span - width:])
    starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    out = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(least)]):
        key = int(least[a].astype(np.int64))
        out += [(key, s, min(LONGEST, b - s)) for s in range(a, b, LONGEST)]
    return out


def headers(docs: DataFrame) -> DataFrame:
    """minimiser, doc_id, first window, windows; no text."""
    def start() -> Callable[..., Iterator[tuple]]:
        def one(doc: int, text: str) -> Iterator[tuple]:
            for key, first, n in super_kmers(words_of(text.encode("utf-8", "replace"))):
                yield key, doc, first, n
        return one

    return flat_map(docs, start, fields("key long,doc_id long,first int,n int"))


def unpacked(z: bytes) -> list[bytes]:
    import zstandard
    return words_of(zstandard.ZstdDecompressor().decompress(z))


def packed_strings(marked: DataFrame) -> DataFrame:
    """The marked super-k-mers of each document as strings: their words, joined by one space."""
    def start() -> Callable[..., Iterator[tuple]]:
        def one(doc: int, z: bytes, spans: list[dict]) -> Iterator[tuple]:
            words = unpacked(z)
            for s in spans:
                if not s["hot"]:
                    yield s["key"], doc, s["first"], b" ".join(words[s["first"]:s["first"] + s["n"] + WINDOW - 1])
        return one

    return flat_map(marked, start, fields("key long,doc_id long,first int,string binary"))


def hot_windows(marked: DataFrame) -> DataFrame:
    """Each different window of each document under a hot minimiser: its 128-bit digest and where it starts."""
    def start() -> Callable[..., Iterator[tuple]]:
        def one(doc: int, z: bytes, spans: list[dict]) -> Iterator[tuple]:
            words, found = None, {}
            for s in spans:
                if s["hot"]:
                    words = words or unpacked(z)
                    for i in range(s["first"], s["first"] + s["n"]):
                        found.setdefault(hashlib.blake2b(b" ".join(words[i:i + WINDOW]), digest_size=16).digest(), []).append(i)
            for digest, starts in found.items():
                yield digest, doc, starts
        return one

    return flat_map(marked, start, fields("digest binary,doc_id long,starts ints"))


def later_windows(strings: DataFrame) -> DataFrame:
    """(doc_id, starts): windows that a document with a smaller id has too. ``strings`` comes sorted by minimiser."""
    schema = fields("doc_id long,starts ints")

    def bucket(rows: list[tuple]) -> Iterator[tuple]:
        if len({doc for doc, _, _ in rows}) < 2:
            return
        windows = []
        for doc, first, string in rows:
            ends = [i for i, b in enumerate(string) if b == 32] + [len(string)]
            begins = [0, *[e + 1 for e in ends[:-1]]]
            windows += [(string[begins[i]:ends[i + WINDOW - 1]], doc, first + i) for i in range(len(ends) - WINDOW + 1)]
        windows.sort()
        window, owner, found = None, None, {}
        for w, doc, at in windows:
            if w != window:
                window, owner = w, doc
            elif doc > owner:
                found.setdefault(doc, []).append(at)
        yield from found.items()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, current, rows = Writer(schema), None, []
        for batch in batches:
            for part in slices(batch):
                for key, doc, first, string in zip(*[c.to_pylist() for c in part.columns]):
                    if key != current:
                        for row in bucket(rows):
                            if (full := out.add(row)) is not None:
                                yield full
                        current, rows = key, []
                    rows.append((doc, first, string))
        for row in bucket(rows):
            if (full := out.add(row)) is not None:
                yield full
        if (rest := out.rest()) is not None:
            yield rest

    return strings.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, ``kept`` (the words that stay, joined by one space) and text_sha256 of each row of ``docs``.

    A word goes when a window that covers it also starts in a document with a smaller
    doc_id; windows are judged on the input. A null text has no words. Rows with a null id,
    or with fewer than ``WINDOW`` words, keep all and take nothing from others. Rows that
    share an id never take from each other, and with equal texts each gets the same result;
    where rows of one id differ in text, each loses the words of the positions found for
    that id. Only doc_id and text are read.
    """
    docs = docs.select("doc_id", text_of().alias("text"))
    known = docs.where("doc_id is not null")
    spans = materialize(headers(known))
    shared = (spans.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum("n").alias("windows"))
              .where("lo < hi").select("key", (F.col("windows") > HOT).alias("hot")))
    marks = (spans.join(shared, "key").groupBy("doc_id")
             .agg(F.sort_array(F.collect_set(F.struct("first", "key", "n", "hot"))).alias("spans")))
    texts = squeezed(docs).withColumnRenamed("doc_id", "id")
    marked = materialize(texts.join(marks, texts.id == marks.doc_id).select("doc_id", "z", "spans").dropDuplicates(["doc_id", "z"]))
    strings = packed_strings(marked).repartition("key").sortWithinPartitions("key", "doc_id", "first")
    hot = hot_windows(marked.where(F.exists("spans", lambda s: s["hot"])))
    owners = hot.groupBy("digest").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("digest", "lo")
    again = hot.join(owners, "digest").where("doc_id > lo").select("doc_id", "starts")
    removed = later_windows(strings).unionByName(again).groupBy("doc_id").agg(F.flatten(F.collect_list("starts")).alias("starts"))

    def start() -> Callable[..., Iterator[tuple]]:
        import zstandard
        press = zstandard.ZstdDecompressor()

        def one(doc: int | None, z: bytes, starts: list[int] | None) -> Iterator[tuple]:
            raw = press.decompress(z)
            words, name = words_of(raw), hashlib.sha256(raw).hexdigest()
            if not starts:
                yield doc, len(words), 0, b" ".join(words).decode(), name
                return
            edges = np.zeros(len(words) + 1, np.int64)
            at = np.unique(np.array(starts, np.int64))
            at = at[at <= len(words) - WINDOW]
            edges[at] += 1
            edges[at + WINDOW] -= 1
            gone = np.cumsum(edges)[:-1] > 0
            yield doc, len(words), int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode(), name
        return one

    joined = texts.join(removed, texts.id == removed.doc_id, "left").select("id", "z", "starts")
    return flat_map(joined, start, fields("doc_id long,n_words long,n_removed long,kept string,text_sha256 string"))
