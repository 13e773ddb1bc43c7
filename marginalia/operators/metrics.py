"""Durations of operations."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "op string, duration double"


class Recorder:
    """Durations in seconds of what was timed in this process."""

    def __init__(self):
        self.rows: list[tuple[str, float]] = []

    def record(self, op: str, duration: float) -> None:
        self.rows.append((op, float(duration)))

    @contextmanager
    def timed(self, op: str) -> Iterator[None]:
        """Record the time of a block, also of one that fails."""
        began = time.perf_counter()
        try:
            yield
        finally:
            self.record(op, time.perf_counter() - began)

    def clear(self) -> None:
        self.rows.clear()

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, SCHEMA)


def report(durations: DataFrame) -> DataFrame:
    """(op, count, total, avg, min, max) of (op, duration), largest total first."""
    d = F.col("duration")
    return durations.groupBy("op").agg(F.count(d).alias("count"), F.sum(d).alias("total"), F.avg(d).alias("avg"), F.min(d).alias("min"), F.max(d).alias("max")).orderBy(F.desc("total"), "op")
