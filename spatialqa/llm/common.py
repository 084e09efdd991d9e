"""Helpers the operators of this package share."""
from __future__ import annotations

from typing import Any, Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from spatialqa.session import discard, materialize  # noqa: F401

#: Rows and bytes of one batch that an operator hands back.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def add_columns(df: DataFrame, function: Callable[..., Iterator[tuple]], reads: list[str], adds: StructType) -> DataFrame:
    """``df`` with columns computed in Python from the columns ``reads``.

    ``function()`` is called once a task and gives a function from the values of
    ``reads`` in one row to a tuple of the new values. Columns of ``df`` that have the
    name of a new one are replaced; all others pass through unchanged.
    """
    new = {f.name.lower() for f in adds.fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    schema = StructType(kept + list(adds.fields))
    sources = [f.name for f in kept] + [f"_in{i}" for i in range(len(reads))]
    frame = df.select(*[F.col(f"`{f.name}`") for f in kept], *[F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(reads)])
    width = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = function()
        types = arrow_types(adds)
        for batch in batches:
            for part in slices(batch):
                values = [work(*row) for row in zip(*[part.column(width + i).to_pylist() for i in range(len(reads))])]
                columns = [part.column(i) for i in range(width)]
                columns += [pa.array([v[i] for v in values], kind) for i, kind in enumerate(types)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return frame.select(*sources).mapInArrow(run, schema)


def flat_map(df: DataFrame, function: Callable[[], Callable[..., Iterator[tuple]]], schema: str | StructType) -> DataFrame:
    """Rows that ``function()(*row)`` yields for each row of ``df``, in bounded batches."""
    schema = struct(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = function()
        out = Writer(schema)
        for batch in batches:
            for part in slices(batch):
                for row in zip(*[c.to_pylist() for c in part.columns]):
                    for result in work(*row):
                        if (full := out.add(result)) is not None:
                            yield full
        if (rest := out.rest()) is not None:
            yield rest

    return df.mapInArrow(run, schema)


class Writer:
    """Collects tuples into record batches of bounded rows and bytes."""

    def __init__(self, schema: StructType) -> None:
        self.names, self.types = [f.name for f in schema.fields], arrow_types(schema)
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, row: tuple) -> pa.RecordBatch | None:
        self.rows.append(row)
        self.bytes += 64 + sum(len(v) if isinstance(v, (bytes, str, list)) else getattr(v, "nbytes", 0) for v in row)
        return self.rest() if len(self.rows) >= 20 * BATCH_ROWS or self.bytes >= BATCH_BYTES else None

    def rest(self) -> pa.RecordBatch | None:
        if not self.rows:
            return None
        columns = [pa.array(c, kind) for c, kind in zip(zip(*self.rows), self.types)]
        self.rows, self.bytes = [], 0
        return pa.RecordBatch.from_arrays(columns, names=self.names)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of about BATCH_BYTES each."""
    rows = max(1, min(BATCH_ROWS, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def struct(schema: str | StructType) -> StructType:
    if isinstance(schema, StructType):
        return schema
    from pyspark.sql.types import _parse_datatype_string
    return _parse_datatype_string(schema)


def arrow_types(schema: StructType) -> list[Any]:
    from pyspark.sql.pandas.types import to_arrow_type
    return [to_arrow_type(f.dataType) for f in schema.fields]


def fields(schema: str) -> StructType:
    """A schema from ``name type, ...``; usable before a session runs."""
    from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType
    kinds = {"long": LongType(), "int": IntegerType(), "double": DoubleType(), "string": StringType(), "binary": BinaryType(),
             "boolean": BooleanType(), "longs": ArrayType(LongType()), "ints": ArrayType(IntegerType())}
    return StructType([StructField(n, kinds[k]) for n, k in (x.split() for x in schema.split(","))])


def text_of(column: str = "text"):
    """Null texts count as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def id_remainder(n: int, column: str = "doc_id"):
    """crc32 of the id written as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def squeezed(docs: DataFrame) -> DataFrame:
    """doc_id and the text as a zstandard frame ``z``: what has to be shuffled whole takes less room."""
    import zstandard

    def start() -> Callable[..., Iterator[tuple]]:
        press = zstandard.ZstdCompressor(level=1)
        return lambda doc, text: [(doc, press.compress(text.encode("utf-8", "replace")))]

    return flat_map(docs.select("doc_id", text_of().alias("text")), start, fields("doc_id long, z binary"))
