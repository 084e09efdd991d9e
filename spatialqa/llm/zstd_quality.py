"""Quality scores from compression.

Two zstandard dictionaries are built, from good and from bad labelled texts. The whole text
is compressed with either, in short blocks so that what a text repeats doesn't hide what
the dictionaries know; the difference of the sizes, divided by the length of the text,
becomes a probability by a logistic curve fitted on other labelled texts.
"""
from __future__ import annotations

import math
from typing import Callable, NamedTuple

import numpy as np
from pyspark.sql import DataFrame, functions as F

from spatialqa.llm.common import add_columns, fields, id_remainder

#: Labelled texts of each class for a dictionary, its bytes, the compression level, and labelled texts for the curve.
SAMPLE, DICTIONARY, LEVEL, CURVE = 400, 1 << 16, 3, 4000
#: Bytes that are compressed on their own, and of the pieces that a dictionary is trained on.
BLOCK = 256


class Model(NamedTuple):
    good: bytes
    bad: bytes
    slope: float
    offset: float


def blocks(data: bytes) -> list[bytes]:
    return [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]


def dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary; the pieces themselves where they are too few, or training finds too little."""
    import zstandard
    pieces = [piece for text in texts for piece in blocks(text)]
    try:
        trained = zstandard.train_dictionary(size, pieces).as_bytes()
    except (zstandard.ZstdError, ValueError):
        trained = b""
    return trained if len(trained) > size // 2 else b"".join(pieces[::max(1, len(pieces) * BLOCK // size)])[:size]


def difference(good: bytes, bad: bytes) -> Callable[[str | None], float]:
    """Bytes saved by the good dictionary over the bad one, for each byte of the text; 0 for an empty text."""
    import zstandard
    bare = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0)
    by_bad, by_good = (zstandard.ZstdCompressor(compression_params=bare, dict_data=zstandard.ZstdCompressionDict(d)).compress for d in (bad, good))

    def one(text: str | None) -> float:
        data = (text or "").encode("utf-8", "replace")
        return sum(len(by_bad(x)) - len(by_good(x)) for x in blocks(data)) / len(data) if data else 0.0
    return one


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's steps with a slight pull to 0; the slope is never negative."""
    scale = float(x.std()) or 1.0
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-3, 1e-6])
        step = np.linalg.solve(h, a.T @ (y - p) - np.array([1e-3, 1e-6]) * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(w[0])) / scale, float(w[1])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, curve_rows: int = CURVE) -> Model:
    """A model from labelled documents whose crc32(doc_id) mod 3 is not 1.

    Learns from a bounded sample, documented by its parameters: ``sample`` texts of each
    class, half of it at most, for the dictionaries and ``curve_rows`` others for the curve, in the order of a
    hash of the id. An id with several labels counts as bad if one of them is. Without
    labels of both classes every score is the share of good ones, or 0.5 without any.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").where(id_remainder(3) != 1).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = docs.where("text is not null and text <> ''").select("doc_id").distinct()
    labelled = ids.join(known, "doc_id").withColumn("h", F.xxhash64("doc_id", F.lit(7)))
    of_class = dict(labelled.groupBy("quality").count().collect())  # two rows
    picked = [labelled.where(f"quality = {q}").orderBy("h", "doc_id").limit(min(sample, -(-of_class.get(q, 0) // 2))) for q in (0, 1)]
    chosen = picked[0].unionByName(picked[1]).select("doc_id", "quality", F.lit(True).alias("shape"))
    others = labelled.join(chosen.select("doc_id"), "doc_id", "left_anti").orderBy("h", "doc_id").limit(curve_rows).select("doc_id", "quality", F.lit(False).alias("shape"))
    rows = chosen.unionByName(others).collect()  # at most 2 * sample + curve_rows ids
    spark = docs.sparkSession
    of = lambda keep: spark.createDataFrame([(r[0], r[1]) for r in rows if r[2] == keep], "doc_id long, quality int")
    at_most = lambda keep: docs.select("doc_id", "text").join(F.broadcast(of(keep)), "doc_id")  # noqa: E731  bounded by the parameters
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    for _, text, q in at_most(True).dropDuplicates(["doc_id"]).toLocalIterator():
        texts[q].append(text.encode("utf-8", "replace"))
    if not texts[0] or not texts[1]:
        n = len(texts[0]) + len(texts[1])
        share = (len(texts[1]) + 0.5) / (n + 1)
        return Model(b"", b"", 0.0, math.log(share / (1 - share)))
    bad, good = (dictionary(sorted(texts[q]), DICTIONARY) for q in (0, 1))

    def start() -> Callable:
        value = difference(good, bad)
        return lambda text: (value(text),)

    fitted = add_columns(at_most(False).dropDuplicates(["doc_id"]), start, ["text"], fields("x double")).select("x", "quality").collect()
    if not fitted:
        fitted = [(difference(good, bad)(t.decode()), q) for q in (0, 1) for t in texts[q]]
    pairs = sorted((x, q) for x, q in fitted)
    return Model(good, bad, *curve(np.array([x for x, _ in pairs]), np.array([float(q) for _, q in pairs])))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``: the probability that the text is good; a null or empty text has the difference 0."""
    def start() -> Callable:
        value = difference(model.good, model.bad) if model.slope else (lambda text: 0.0)
        return lambda text: (1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * value(text) + model.offset)))),)

    return add_columns(docs, start, ["text"], fields("score double"))
