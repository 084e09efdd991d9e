"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes what its predecessor kept. All but the last return the columns of
documents, others of any name among them. Nulls, empty and very long texts, ties, repeated
rows and ids: see each stage and its operator; an empty table stays empty. None of the
decisions but the near duplicates and the repeated passages can be stated in SQL, so there is
no oracle; the stages and ``run`` are tested against plain loops.
"""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from spatialqa.llm import hamming, mixture, packing, superkmers, zstd_quality
from spatialqa.llm.common import discard, id_remainder, materialize
from spatialqa.llm.queries import tokenizer

#: The least similarity, in percent, of near duplicates in the corpus; op9 has its own.
NEAR = 80
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def judged(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], keep: str) -> DataFrame:
    """The rows of ``docs`` for which ``keep`` holds in what ``judge`` adds to them; its columns never meet theirs."""
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    apart = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(name) for c, name in own.items()])
    return judge(apart).where(keep).select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier good than bad; a null or empty text is judged as empty."""
    model = zstd_quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged(docs, lambda rows: zstd_quality.score(rows, model), "score >= 0.5")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that makes up half of them or more; a text without a letter has none."""
    names, table = mixture.learn(docs.where(id_remainder(5) != 0))
    return judged(docs, lambda rows: mixture.predict(rows, names, table), f"lang_pred <> '{mixture.UNKNOWN}' and score >= 0.5")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates: ``NEAR`` percent of their five-word shingles in common, linked directly or through others.

    Rows of one id are one document and stay or go together; a row without an id stays.
    """
    dropped = hamming.near_duplicates(docs, NEAR).where("not kept").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that one with a smaller id has; those left without a word go.

    Untouched texts stay as they are, and so do the texts of an id that has several.
    """
    cut = (superkmers.remove_repeats(docs).groupBy("doc_id")
           .agg(F.min(F.when(F.col("n_removed") > 0, F.col("kept"))).alias("cut"), F.min("text_sha256").alias("lo"), F.max("text_sha256").alias("hi"))
           .where("cut is not null and lo = hi").select(F.col("doc_id").alias("id"), "cut"))
    own = {c: f"own_{i}" for i, c in enumerate(docs.columns)}
    both = docs.select(*[F.col(f"`{c}`").alias(name) for c, name in own.items()]).join(cut, F.col(own["doc_id"]) == F.col("id"), "left")
    text = F.coalesce("cut", own["text"])
    new = {"text": text}
    if "n_chars" in own:
        new["n_chars"] = F.when(F.col("cut").isNull(), F.col(own["n_chars"])).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return both.where("cut is null or cut <> ''").select(*[new.get(c, F.col(name)).alias(c) for c, name in own.items()])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return packing.pack_words(docs, tokenizer("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again, and goes once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir))
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
