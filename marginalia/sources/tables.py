"""Notes from JSON, and from the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.schema import IMPORT


def from_json(spark: SparkSession, path: str) -> DataFrame:
    """(title, content, tags) of JSON arrays, one or more to a file."""
    return spark.read.schema(IMPORT).option("multiLine", "true").json(path)


def sample_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes: type, tags, links and wiki links follow from doc_id by arithmetic. Links are drawn from half as many numbers again as
    there are documents, so that a third of them have no target."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n, size = F.col("doc_id"), docs.count()
    mod = lambda a, b: F.pmod(n * a + b, F.lit(size + size // 2)).cast("string")
    return docs.select(
        n.cast("string").alias("id"),
        n.alias("ord"),
        F.concat(F.lit("Doc "), n.cast("string")).alias("title"),
        F.concat("text", F.lit("\nSee [[Doc "), mod(3, 1), F.lit("]], [["), mod(11, 7), F.lit("]] and [[ doc "), mod(13, 5), F.lit(" ]].")).alias("content"),
        F.element_at(F.array(*map(F.lit, ("fleeting", "literature", "permanent"))), (n % 3 + 1).cast("int")).alias("type"),
        F.array("lang", "source").alias("tags"),
        F.array(mod(7, 3), mod(5, 1)).alias("links"),
    )


def sample_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as vectors of the notes of the same number."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return v.select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("ord"), "embedding", "label")


def turn_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations as vertices, each linked with the next turn."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn").distinct()
    name = lambda t: F.concat(F.lpad(F.col("conv_id").cast("string"), 12, "0"), F.lit("-"), F.lpad(t.cast("string"), 6, "0"))
    vertices = c.select(name(F.col("turn")).alias("id"), "conv_id", "turn")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"))
    edges = c.join(after, ["conv_id", "turn"]).select(name(F.col("turn")).alias("src"), name(F.col("turn") + 1).alias("dst"), F.lit("links").alias("type"))
    return vertices, edges
