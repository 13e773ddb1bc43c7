"""A watched folder: its Markdown files are listed as a table, and two listings give the change events in between.

Each poll writes its events as JSON files where a stream of ``indexer.events`` takes them up, then the listing that the next poll compares with.
A poll that fails in between writes the same events again, which the last event of a note makes harmless.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTING = "path string, modified timestamp, size long"


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, size) of the Markdown files below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    return found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Events (path, ts, op) from one listing to the next. A deleted file has the present time."""
    before = old.select("path", F.col("modified").alias("was"), F.col("size").alias("had"))
    both = before.join(new, "path", "full_outer")
    op = F.when(F.col("was").isNull(), "created").when(F.col("modified").isNull(), "deleted").when((F.col("was") != F.col("modified")) | (F.col("had") != F.col("size")), "modified")
    return both.select("path", F.when(F.col("modified").isNull(), F.current_timestamp()).otherwise(F.col("modified")).alias("ts"), op.alias("op")).filter("op is not null")


class FolderWatcher:
    """``poll`` compares a folder with what it was at the last poll; ``state`` and ``events`` are folders that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, events: str, state: str):
        self.spark, self.folder, self.events, self.state = spark, folder, events, state.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _last(self) -> str | None:
        fs, top = self._fs(self.state)
        if not fs.exists(top):
            return None
        names = sorted(s.getPath().getName() for s in fs.listStatus(top) if not s.getPath().getName().endswith(".new"))
        return names[-1] if names else None

    def poll(self) -> int:
        """Write the events since the last poll; how many they are."""
        last = self._last()
        old = self.spark.read.schema(LISTING).parquet(f"{self.state}/{last}") if last else self.spark.createDataFrame([], LISTING)
        path = f"{self.state}/{int(last.split('-')[0]) + 1 if last else 0:012}-{uuid.uuid4().hex}"
        new = listing(self.spark, self.folder)
        new.write.parquet(f"{path}.new")
        new = self.spark.read.schema(LISTING).parquet(f"{path}.new")
        found = changes(old, new)
        n = found.count()
        if n:
            found.write.mode("append").json(self.events)
        fs, made = self._fs(f"{path}.new")
        fs.rename(made, self._fs(path)[1])
        if last:
            fs.delete(self._fs(f"{self.state}/{last}")[1], True)
        return n
