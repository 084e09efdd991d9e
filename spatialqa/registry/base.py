"""Named queries with the SQL that must give the same rows."""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


def tidy(df: DataFrame) -> DataFrame:
    """Output types both engines share: bigint, double rounded to 6 places, string, boolean."""
    out = []
    for field in df.schema.fields:
        name, kind = field.name, field.dataType.typeName()
        if kind in ("byte", "short", "integer", "long"):
            out.append(F.col(name).cast("bigint").alias(name))
        elif kind in ("float", "double", "decimal"):
            value = F.col(name).cast("double")
            # Away from zero on the scaled double, as the SQL side rounds.
            out.append((F.signum(value) * F.floor(F.abs(value) * 1e6 + 0.5) / 1e6 + 0.0).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)
