"""Any function over rows in batches, with failures counted."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def each(rows: DataFrame, function: Callable[[dict], dict], schema: str) -> DataFrame:
    """``function`` of each row as a dictionary; ``schema`` names what it gives. A row on which it fails gives nulls and its ``problem``."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                try:
                    out.append({**function(row), "problem": None})
                except Exception as e:
                    out.append({"problem": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame([{c: r.get(c) for c in (*names, "problem")} for r in out], columns=[*names, "problem"])

    return rows.mapInPandas(run, f"{schema}, problem string")


def good(done: DataFrame) -> DataFrame:
    return done.filter("problem is null").drop("problem")


def counts(done: DataFrame) -> DataFrame:
    """One row: total, done, failed."""
    return done.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("problem").isNull()).alias("done"), F.count_if(F.col("problem").isNotNull()).alias("failed"))
