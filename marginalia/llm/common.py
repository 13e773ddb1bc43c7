"""Shared plumbing of the corpus operators: scratch tables, column choice and a join that survives hot keys."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.session import ship

#: Most rows that a side may hold to be broadcast; every use counts the side first and has another way beyond it.
BROADCAST_ROWS = 200_000
#: Rows of an Arrow batch.
BATCH = 1000
#: Bytes of a row group of scratch tables, which a task holds while it writes.
ROW_GROUP = 16 << 20
#: Characters of a bucket of scratch tables.
BUCKET = 32 << 20


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``. Only a session within one process may leave that unset, and gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="marginalia-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def tidy(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps, which it does when the driver's JVM collects its garbage; a small driver seldom does that
    by itself. Spark holds on to the last step until the next one has ended, so the files of a step may go only before the one after the next."""
    spark.sparkContext._jvm.System.gc()


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared scratch folder and read again: lineage is cut and a lost executor costs a read."""
    prepared(df.sparkSession)
    tidy(df.sparkSession)
    path = f"{scratch_dir(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    tidy(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def bucketed(df: DataFrame, key: str, chars: int) -> DataFrame:
    """``df`` with about ``chars`` characters of text, written once and sorted into buckets by ``key``, so that joins and groups by that key move
    only their other side. ``discard`` also forgets the table's name."""
    spark = df.sparkSession
    prepared(spark)
    tidy(spark)
    path, name = scratch_dir(spark), f"marginalia_{uuid.uuid4().hex}"
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chars // BUCKET + 1)
    held = df.repartition(n, key).write.bucketBy(n, key).sortBy(key)
    held.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).option("path", path).saveAsTable(name)
    tidy(spark)
    out = spark.table(name)
    out._scratch, out._name = path, name
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing will read again."""
    for t in tables:
        if name := getattr(t, "_name", None):
            t.sparkSession.sql(f"DROP TABLE {name}")
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_state: dict = {}


def process_state(name: str, make=lambda: None):
    """What an operator keeps in a Python worker between tasks. A worker holds the state of one operator at a time, and gives freed memory back
    to the system, so that the stages of a pipeline don't add up. Operators without state call this by their name alone."""
    if name not in _state:
        _state.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)
        _state[name] = make()
    return _state[name]


def prepared(spark: SparkSession) -> None:
    """Ship the package, and send texts to Python in batches of BATCH rows unless the session asks for another size: some texts are very long."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepared(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """The name, with more underscores if the table has a column of that name already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "left", share: int = 2000, counts: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right``, whose ``key`` is unique.

    A key with more than 1/``share`` of the left rows is hot. Its left rows are dealt over parts of that size by a hash of the whole row, and its
    right row stands once for each part. There are fewer than ``share`` hot keys, and only these keys are broadcast. ``counts``: (key, _n) where
    the rows of each key are counted already.
    """
    if counts is None:
        counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    limit = max(1000, left.count() // share)
    hot = counts.filter((F.col("_n") > limit) & F.col(key).isNotNull()).select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_parts"))
    found = hot.collect()
    if not found:
        return left.join(right, key, how)
    hot = F.broadcast(left.sparkSession.createDataFrame(found, hot.schema))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("_parts")
    copied = right.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copied, [key, "_part"], how).drop("_part")


def join_bucketed(left: DataFrame, right: DataFrame, key: str, share: int = 2000) -> DataFrame:
    """``left``, a scratch table, joined with ``right``, whose ``key`` is unique and which is in buckets by it. Rows of hot keys go by ``join_hot``
    with the few rows on the right that they need; all others leave the right side where it is."""
    limit = max(1000, left.count() // share)
    hot = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    found = hot.collect()
    if not found:
        return left.join(right, key)
    hot = F.broadcast(left.sparkSession.createDataFrame(found, hot.schema))
    dealt = join_hot(left.join(hot, key, "left_semi"), right.join(hot, key, "left_semi"), key, "inner", counts=hot)
    return left.join(hot, key, "left_anti").join(right, key).unionByName(dealt)


#: Most words of the bitmap of ``sieved``: 64 million bits, a million small rows to broadcast. Beyond that more rows pass it.
SIEVE_WORDS = 1 << 20


def sieved(rows: DataFrame, wanted: DataFrame, key: str, most: int = SIEVE_WORDS) -> DataFrame:
    """The rows of the wanted keys and a few more, by a bitmap of about 16 bits for each key that is broadcast in words of 64, ``most`` at most.
    It goes ahead of a join, which then moves fewer rows."""
    size = min(most, max(1 << 10, 1 << (wanted.count() // 4).bit_length()))
    word, place = F.pmod(F.xxhash64(key), F.lit(size)).cast("int"), F.pmod(F.xxhash64(F.lit(1), key), F.lit(64)).cast("int")
    bit = F.expr("shiftleft(1L, _place)")
    words = wanted.select(word.alias("_word"), place.alias("_place")).groupBy("_word").agg(F.bit_or(bit).alias("_bits"))
    held = rows.withColumn("_word", word).withColumn("_place", place).join(F.broadcast(words), "_word")
    return held.filter(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_place", "_bits")


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``df`` without the rows whose ``key`` is in ``keys``, which is broadcast only after a count."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, key, "left_anti")


def _flat(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, root) of parents, by pointer jumping: every round halves each path."""
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = saved(parents.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "parents")
        if jumped.filter("moved").isEmpty():
            return jumped.drop("moved")
        parents = jumped.drop("moved")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distributed union-find: (node, root) for every node of the edges, the root being the smallest node it is connected with.

    In each round every node with a smaller neighbour is hooked onto the smallest one, the hooks are flattened, and the edges move to the roots;
    a node is hooked once at most, and only local minima are left, so the edges run out in few rounds. Each round is written to the shared
    folder.
    """
    low, high = F.least(a, b).alias("low"), F.greatest(a, b).alias("high")
    left = saved(edges.select(low, high).filter("low < high").distinct(), "edges")
    nodes = left.select(F.col("low").alias("node")).union(left.select("high")).distinct()
    forest = None
    while not left.isEmpty():
        hooks = _flat(left.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("root")))
        forest = hooks if forest is None else forest.unionByName(hooks)
        to_low, to_high = (hooks.select(F.col("node").alias(x), F.col("root").alias(f"new_{x}")) for x in ("low", "high"))
        moved = left.join(to_high, "high").join(to_low, "low", "left").select(F.coalesce("new_low", "low").alias("x"), F.col("new_high").alias("y"))
        left = saved(moved.select(F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high")).filter("low < high").distinct(), "edges")
    if forest is None:
        return nodes.select("node", F.col("node").alias("root"))
    return nodes.join(_flat(forest), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
