"""Filter interaction audit by min-plus removal ranks.

Every document fails some of five filters. The failures are a row of a mask matrix (0 where
it fails, infinity elsewhere), the place of each filter in an order a column of the
inverse-permutation matrix. Their min-plus product is the step at which that order removes
the document. Documents only count by (part, failures); the product is taken once for the 32
possible rows, and its steps say where the counts are added.
"""
from __future__ import annotations

import re
from itertools import permutations
from typing import Any, Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from spatialqa.llm.common import add_columns, fields, flat_map, text_of

FILTERS = "ABCDE"
#: Words that a text needs; distinct words, percent; capitals, percent.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
JUNK = re.compile(r"[#$%&*|]")
NOT_CAPITAL = bytes(b for b in range(256) if not 65 <= b <= 90)
MASKS = 1 << len(FILTERS)
RESULT = ("part string,filter_order string,step int,kept long,removed long,redundant long,unique_fails long,"
          "good_lost long,toxic_lost long,shapley long")


def own_failures(text: str | None) -> int:
    """The filters A to D that a text fails, A in the lowest bit. Null counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()  # splits at exactly the six ASCII white-space bytes
    capitals = len(raw.translate(None, NOT_CAPITAL))
    return ((len(words) < LEAST_WORDS) | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
            | (100 * capitals > MOST_CAPITALS * len(text)) << 2 | (JUNK.search(text) is not None) << 3)


def steps() -> tuple[list[str], np.ndarray, np.ndarray]:
    """All orders; for each order and each filter its place (0-based); for each order and each set of failures the removal step, or 5."""
    orders = list(permutations(range(len(FILTERS))))
    places = np.argsort(np.array(orders), axis=1)
    fails = (np.arange(MASKS)[:, None] >> np.arange(len(FILTERS))) & 1
    never = len(FILTERS)
    masks = np.where(fails == 1, 0, never)
    removal = np.minimum((masks[None, :, :] + places[:, None, :]).min(axis=2), never)
    return ["".join(FILTERS[i] for i in order) for order in orders], places, removal


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failures, good and toxic for each row of ``docs``.

    Equal texts are found by the digest of the text: one row for each digest has its smallest
    id, and a row passes E if it is that row; the pair (digest, id) is the key of the join, so
    a text with very many copies is no hot key.
    """
    rows = add_columns(docs.select("doc_id", "source", "text"), lambda: lambda text: (own_failures(text),), ["text"], fields("own int"))
    rows = rows.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.sha2(text_of().cast("binary"), 256).alias("digest"), "own")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    first = first.select("doc_id", "digest", F.lit(True).alias("is_first"))
    marked = (labels.where("doc_id is not null").groupBy("doc_id")
              .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad")))
    both = rows.join(first, ["doc_id", "digest"], "left").join(marked, "doc_id", "left")
    again = F.col("is_first").isNull() & F.col("doc_id").isNotNull()
    return both.select("part", (F.col("own") + F.when(again, 1 << FILTERS.index("E")).otherwise(0)).alias("failures"),
                       F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("toxic"))


def audited(masks: list[int], counts: list[tuple[int, int, int]]) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of one part from the counts (documents, good, toxic) of its masks."""
    names, places, removal = steps()
    n, width = len(names), len(FILTERS) + 1
    held = removal[:, masks]
    cells = (np.arange(n)[:, None] * width + held).ravel()
    weights = np.array(counts, np.int64)
    scattered = np.zeros((3, n * width), np.int64)
    for i in range(3):
        np.add.at(scattered[i], cells, np.tile(weights[:, i], n))
    removed, good, toxic = scattered.reshape(3, n, width)
    kept = weights[:, 0].sum() - np.cumsum(removed, axis=1)
    fails = (np.array(masks)[:, None] >> np.arange(len(FILTERS))) & 1
    failing = fails.T @ weights[:, 0]
    unique = (fails * (fails.sum(axis=1) == 1)[:, None]).T @ weights[:, 0]
    shapley = np.array([removed[np.arange(n), places[:, f]].sum() for f in range(len(FILTERS))])
    for o, name in enumerate(names):
        for step in range(len(FILTERS)):
            f = FILTERS.index(name[step])
            yield (name, step + 1, int(kept[o, step]), int(removed[o, step]), int(failing[f] - removed[o, step]), int(unique[f]),
                   int(good[o, step]), int(toxic[o, step]), int(shapley[f]))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (source), filter order and step: what the step's filter removes and what that interacts with.

    A null text counts as empty, a null source as the empty part, and a part has all its 600
    rows, zeros included. A row without an id is never identical to an earlier one, nor are
    repeated rows of one id and text. Labels are one for each id (the largest, if an id is
    marked more than once); null ones count as 0. An empty table gives no rows. Only doc_id,
    text and source, and doc_id, quality and toxic of ``labels``, are read, whatever else
    there is; a text of any length is one row.
    """
    counted = failures(docs, labels).groupBy("part", "failures").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("failures", "n", "good", "toxic")).alias("cells"))  # 32 at most
    rows = parts.select("part", *[F.col(f"cells.{c}").alias(c) for c in ("failures", "n", "good", "toxic")])

    def start() -> Callable[..., Iterator[tuple]]:
        def one(part: str, masks: list[int], *counts: Any) -> Iterator[tuple]:
            for row in audited(masks, list(zip(*counts))):
                yield part, *row
        return one

    return flat_map(rows, start, fields(RESULT))
