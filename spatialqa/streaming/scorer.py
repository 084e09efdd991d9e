"""User scorer over work-list rows, one failing row never failing the job."""
from __future__ import annotations

from typing import Any, Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StringType, StructField, StructType


def run_scorer(plan: DataFrame, score: Callable[[dict[str, Any]], list[dict[str, Any]]], item: StructType) -> DataFrame:
    """``plan`` rows plus ``found`` (array of ``item``), ``status`` and ``error``.

    ``score`` gets one row as a dict and returns the items found. Rows already refused keep
    their status. An exception marks its row ``failed`` with the error text.
    """
    extra = [StructField("found", ArrayType(item)), StructField("status", StringType()), StructField("error", StringType())]
    base = [f for f in plan.schema.fields if f.name not in ("found", "status", "error")]
    refused = "status" in plan.columns

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found, status, errors = [], [], []
            for row in frame.to_dict("records"):
                if refused and row.get("status") == "budget_exhausted":
                    found.append([]); status.append("budget_exhausted"); errors.append(None)
                    continue
                try:
                    found.append(list(score(row))); status.append("ok"); errors.append(None)
                except Exception as error:
                    found.append([]); status.append("failed"); errors.append(f"{type(error).__name__}: {error}")
            out = frame[[f.name for f in base]].copy()
            out["found"], out["status"], out["error"] = found, status, errors
            yield out

    return plan.mapInPandas(work, StructType(base + extra))


def scorer_results(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per item found, scan log with the number of candidates)."""
    from pyspark.sql import functions as F
    keep = [c for c in scored.columns if c not in ("found", "status", "error")]
    items = scored.filter(F.size("found") > 0).select(*keep, F.inline("found"))
    return items, scored.withColumn("candidates", F.size("found")).drop("found")
