"""Language mixtures of documents by expectation-maximisation over n-gram likelihoods.

Each language has smoothed frequencies of hashed byte trigrams of lower-cased text. For a
document, expectation-maximisation estimates the proportions of all languages; sets of the
one, two, ... most frequent ones are then fitted anew, and the set grows while the
likelihood rises by more than the penalty of another language.
"""
from __future__ import annotations

import re
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from spatialqa.llm.common import arrow_types, fields, slices

BUCKETS, SMOOTH, ROUNDS = 1 << 16, 0.5, 8
#: A further language must raise the log-likelihood by this many times log(trigrams) / 2; trigrams overlap, so more than 1.
PENALTY = 6.0
#: Languages whose counts a task holds before it hands them on, and likelihoods it computes at once.
HELD, AT_ONCE = 32, 800_000
UNKNOWN = "und"
#: Letters, and numbers such as fractions, which aren't.
LETTER_LIKE = re.compile(r"[^\W\d_]")
K = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in LETTER_LIKE.finditer(text))


def trigrams(text: str) -> np.ndarray:
    """The buckets of all byte trigrams of the lower-cased text with a space at each end."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    return (b[:-2] * K[0] + b[1:-1] * K[1] + b[2:] * K[2]) >> np.uint32(16)


def language_counts(docs: DataFrame) -> DataFrame:
    """lang, bucket, n over all given documents with a language and a letter; counted in the tasks before the shuffle."""
    schema = fields("lang string,bucket int,n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def empty() -> Iterator[pa.RecordBatch]:
            for lang, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=schema.names)
            held.clear()

        for batch in batches:
            for part in slices(batch):
                found: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(*[c.to_pylist() for c in part.columns]):
                    if text and has_letter(text):
                        found.setdefault(lang, []).append(trigrams(text))
                for lang, grams in found.items():
                    if lang not in held and len(held) >= HELD:
                        yield from empty()
                    held[lang] = held.get(lang, 0) + np.bincount(np.concatenate(grams), minlength=BUCKETS)
        yield from empty()

    return docs.where("lang is not null").select("lang", "text").mapInArrow(run, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Language names in order and their trigram likelihoods, each divided by the largest over the languages.

    Its size is the number of languages times BUCKETS floats, whatever the size of the corpus.
    """
    rows = language_counts(docs).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("c")).orderBy("lang").select("lang", "c.bucket", "c.n").toLocalIterator()
    names, table = [], []
    for lang, bucket, n in rows:
        counts = np.full(BUCKETS, SMOOTH)
        counts[np.array(bucket)] += np.array(n)
        names.append(lang)
        table.append(counts / counts.sum())
    if not names:
        return [], np.zeros((0, BUCKETS), np.float32)
    p = np.array(table)
    return names, np.ascontiguousarray(p / p.max(axis=0), np.float32)


def fit(r: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the rows of ``r`` (languages) in each document (columns from ``starts``), and the log-likelihoods."""
    mix = np.full((len(r), len(starts)), 1 / len(r), np.float32)
    for _ in range(rounds if len(r) > 1 else 0):
        w = np.repeat(mix, sizes, axis=1)
        w *= r
        w /= w.sum(axis=0)
        mix = np.add.reduceat(w, starts, axis=1) / sizes.astype(np.float32)
    total = (np.repeat(mix, sizes, axis=1) * r).sum(axis=0)
    return mix, np.add.reduceat(np.log(np.maximum(total, 1e-30)), starts, dtype=np.float64)


def mixtures(grams: list[np.ndarray], table: np.ndarray) -> list[list[tuple[int, float]]]:
    """For each document the chosen languages, most frequent first, with their proportions. ``table``: language by bucket."""
    sizes = np.array([len(g) for g in grams])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    codes = np.concatenate(grams)
    r = table[:, codes]
    order = np.argsort(-fit(r, starts, sizes)[0], axis=0, kind="stable")
    single = np.add.reduceat(np.log(np.maximum(r, 1e-30)), starts, axis=1, dtype=np.float64)
    led = order[0].copy()
    order[0] = single.argmax(axis=0)
    for k in range(1, len(order)):  # the likeliest single language leads; the one it displaces takes its place
        again = order[k] == order[0]
        order[k, again] = led[again]
    best, chosen = single.max(axis=0), [[(int(o), 1.0)] for o in order[0]]
    open_ = np.arange(len(grams))
    flat = table.ravel()
    for k in range(2, len(table) + 1):
        width = sizes[open_]
        first = np.concatenate(([0], np.cumsum(width)[:-1]))
        own = codes if len(open_) == len(grams) else np.concatenate([grams[i] for i in open_])
        part = np.stack([flat[np.repeat(order[j, open_] * BUCKETS, width) + own] for j in range(k)])
        mix, found = fit(part, first, width)
        better = found - best[open_] > PENALTY * np.log(width) / 2
        for i in np.flatnonzero(better):
            chosen[open_[i]] = sorted(((int(o), float(m)) for o, m in zip(order[:k, open_[i]], mix[:, i])), key=lambda x: (-x[1], x[0]))
        best[open_[better]] = found[better]
        open_ = open_[better]
        if not len(open_):
            break
    return chosen


def predict(docs: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """``docs`` with lang_pred, score (the proportion of that language) and languages (all chosen, "name:proportion").

    A null text, or one without a letter, is ``und`` with score 0; so is every text when no
    language was learned. Ties go to the first name. Columns of these names are replaced.
    """
    adds = fields("lang_pred string,score double,languages string")
    new = {f.name for f in adds.fields}
    kept = [f for f in docs.schema.fields if f.name.lower() not in new]
    schema, text_at = StructType([*kept, *adds.fields]), [f.name for f in kept].index("text")
    model = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likelihoods = model.value
        most = max(1, AT_ONCE // max(1, len(likelihoods)))
        for batch in batches:
            for part in slices(batch):
                texts = part.column(text_at).to_pylist()
                found: list[tuple] = [(UNKNOWN, 0.0, None)] * len(texts)
                wait: list[int] = []
                grams: list[np.ndarray] = []
                much = 0
                for i, text in enumerate([*texts, None]):
                    if len(likelihoods) and text and has_letter(text):
                        wait.append(i)
                        grams.append(trigrams(text))
                        much += len(grams[-1])
                    if wait and (i == len(texts) or much > most):
                        for at, mix in zip(wait, mixtures(grams, likelihoods)):
                            found[at] = (names[mix[0][0]], min(1.0, mix[0][1]), " ".join(f"{names[j]}:{share:.3f}" for j, share in mix))
                        wait, grams, much = [], [], 0
                columns = [part.column(i) for i in range(len(kept))] + [pa.array(c, t) for c, t in zip(zip(*found), arrow_types(adds))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)
