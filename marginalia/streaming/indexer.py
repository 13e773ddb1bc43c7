"""Incremental indexing from a stream of change events (path, ts, op), op being created, modified or deleted.

File sources read each path once, so changes come as events. Events of a path that follow one another within the debounce time are one change,
by session windows with a watermark; each batch of settled changes then updates both indexes: the last event of a note wins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia.functions.text import id_of_stem

@dataclass
class IndexStats:
    """Counters of a run of the indexer."""

    total_indexed: int = 0
    total_deleted: int = 0
    last_indexed: datetime | None = None
    pending_changes: int = 0
    errors: list[str] = field(default_factory=list)


EVENTS = "path string, ts timestamp, op string"
DEBOUNCE = "1 second"


def events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of events from JSON files that land in a folder."""
    return spark.readStream.schema(EVENTS).json(folder)


def settled(changes: DataFrame, gap: str = DEBOUNCE, late: str = "10 seconds") -> DataFrame:
    """(path, ts, op, events): the last event of each run of events of a path with pauses below ``gap``. For streams and tables."""
    notes = changes.filter(F.endswith("path", F.lit(".md")))
    marked = notes.withWatermark("ts", late) if changes.isStreaming else notes
    runs = marked.groupBy(F.session_window("ts", gap), "path").agg(F.max("ts").alias("ts"), F.max_by("op", "ts").alias("op"), F.count(F.lit(1)).alias("events"))
    return runs.select("path", "ts", "op", "events")


def latest(changes: DataFrame) -> DataFrame:
    """(id, path, op, ts) of the last change of each note; paths without an id are left out."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/\\]*)$", 1), r"\.md$", "")
    named = changes.select(id_of_stem(stem).alias("id"), "path", "op", "ts").filter("id is not null")
    return named.groupBy("id").agg(F.max_by(F.struct("path", "op", "ts"), "ts").alias("x")).select("id", "x.*")


def watch(changes: DataFrame, apply: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, gap: str = DEBOUNCE, available_now: bool = False) -> StreamingQuery:
    """Run ``apply(upserts, deletes, batch)`` for each batch of settled changes. A batch may come again after a failure, so ``apply`` must replace
    what it wrote for the same batch."""

    def each(batch: DataFrame, number: int) -> None:
        last = latest(batch).persist()
        try:
            apply(last.filter("op <> 'deleted'"), last.filter("op = 'deleted'"), number)
        finally:
            last.unpersist()

    writer = settled(changes, gap).writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def updated(index, vectors: DataFrame, upserts: DataFrame, deletes: DataFrame, read: Callable[[DataFrame], DataFrame], encode: Callable[[DataFrame], DataFrame]):
    """Both indexes after a batch. ``read`` gives (id, ord, text) of the changed notes, ``encode`` their vectors."""
    from marginalia.operators import bm25
    from marginalia.operators import vectors as store

    new = read(upserts)
    ids = deletes.select("id")
    return bm25.upsert(bm25.remove(index, ids), new), store.upsert(store.remove(vectors, ids), encode(new))
