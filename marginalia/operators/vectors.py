"""Dense vectors: exact cosine search, and text encoders."""

from __future__ import annotations

import logging
import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from marginalia.functions.text import has_all_tags
from marginalia.session import ship

DIMENSION = 384
#: Query vectors that are broadcast against the table at once; more go in blocks of this size.
FEW_QUERIES = 10_000
#: Queries whose products with a batch of vectors are held at once.
CHUNK = 128
#: Vectors whose products with queries are found at once; each lot gives the k best of every query.
LOT = 8192
#: What a matrix product's dot products of unit vectors may differ by from sums in order; ten thousand times the rounding of doubles at most.
SLACK = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; 0 where a vector is zero."""
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length).otherwise(0.0)


def unit(a: Column) -> Column:
    """The vector in doubles and of length 1; a zero vector stays zero."""
    # Inside a list of one, the length is found once, not for each dimension.
    return F.element_at(F.transform(F.array(F.sqrt(dot(a, a))), lambda length: F.transform(a, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(0.0))), 1)


def in_blocks(queries: DataFrame, size: int, key: str = "query_id") -> list[DataFrame]:
    """The queries in blocks of about ``size`` rows by a hash of their key, each small enough to be broadcast."""
    n = queries.count()
    if n <= size:
        return [queries]
    blocks = -(-n // (size // 2))
    return [queries.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == b) for b in range(blocks)]


def require_dimension(vectors: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    """The same vectors; a row of another size fails the job instead of being padded."""
    same = F.size(column) == dimension
    return vectors.withColumn(column, F.when(same, F.col(column)).otherwise(F.raise_error(F.concat(F.lit("vector of size "), F.size(column).cast("string")))))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, note_type: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """(query_id, id, distance, score, rank) of the k nearest (id, embedding[, type, tags]) to each (query_id, vector); filters come before."""
    if note_type is not None:
        vectors = vectors.filter(F.col("type") == note_type)
    if tags:
        vectors = vectors.filter(has_all_tags(F.col("tags"), tags))
    table = vectors.select("id", F.col("embedding").cast("array<double>").alias("_raw"))
    asked = queries.select("query_id", unit(F.col("vector")).alias("_asked"))
    near = reduce(DataFrame.unionByName, [pair for q in in_blocks(asked, FEW_QUERIES) for pair in _near(table, q, k)])
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "id", (1 - F.col("score")).alias("distance"), "score", "rank")


def _near(table: DataFrame, asked: DataFrame, k: int) -> list[DataFrame]:
    """Tables (query_id, id, score) that hold the k nearest of each query. Vectors of the size of the queries meet them by products of matrices;
    those with nulls, of another size or without length are compared one by one."""
    size = asked.agg(F.max(F.size("_asked"))).first()[0]
    plain = lambda c: F.coalesce((F.size(c) == size) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    units = lambda t: t.select("id", unit(F.col("_raw")).alias("_unit"))
    each = lambda t, q: units(t).join(F.broadcast(q), how="cross").select("query_id", "id", dot(F.col("_unit"), F.col("_asked")).alias("score"))
    if size is None or size < 1:
        return [each(table, asked)]
    many = asked.filter(plain("_asked")).toArrow()
    odd = asked.filter(~plain("_asked"))
    out = [each(table.filter(~plain("_raw")), asked)] + ([] if odd.isEmpty() else [each(table.filter(plain("_raw")), odd)])
    if not many.num_rows:
        return out
    spark = table.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((many.column("query_id").combine_chunks(), _matrix(many.column("_asked").combine_chunks(), size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, wanted = sent.value
        for ids, lists in _lots(batches):
            own = _units(_matrix(lists, size))
            for at in range(0, len(wanted), CHUNK):
                row, query, score = _best(own, wanted[at : at + CHUNK], k)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(query + at)), ids.take(pa.array(row)), pa.array(score)], names=["query_id", "id", "score"])

    schema = StructType([asked.schema["query_id"], table.schema["id"]]).add("score", DoubleType())
    return [*out, table.filter(plain("_raw")).mapInArrow(run, schema)]


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Both columns of the batches, in lots of at least ``LOT`` rows but for the last."""
    kept: list[pa.RecordBatch] = []
    for b in chain(batches, [None]):
        if b is not None and b.num_rows:
            kept.append(b)
        if kept and (b is None or sum(x.num_rows for x in kept) >= LOT):
            yield tuple(pa.concat_arrays([x.column(c) for x in kept]) for c in (0, 1))
            kept = []


def _units(own: np.ndarray) -> np.ndarray:
    """As ``unit``, with sums in the same order."""
    square = np.zeros(len(own))
    with np.errstate(over="ignore"):
        for x in own.T:
            square += x * x
    length = np.sqrt(square)[:, None]
    return np.divide(own, length, out=np.zeros_like(own), where=length > 0)


def _matrix(lists: pa.Array, size: int) -> np.ndarray:
    return pc.list_flatten(lists).to_numpy(zero_copy_only=False).reshape(-1, size)


def _best(own: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, query, score) of all rows that may be among the k nearest to a query; scores are sums in the order of dimensions, as in ``dot``."""
    close = own @ wanted.T
    if len(own) > k:
        close = close >= np.partition(close, len(own) - k, axis=0)[len(own) - k] - SLACK
    else:
        close = np.ones_like(close, bool)
    row, query = np.nonzero(close)
    score = np.zeros(len(row))
    for a, b in zip(own.T, wanted.T, strict=True):
        score += a[row] * b[query]
    return row, query, score


def hashed_bag(texts: list[str], dimension: int = DIMENSION) -> np.ndarray:
    """A deterministic stand-in for a trained encoder: signed counts of hashed words, of unit length."""
    out = np.zeros((len(texts), dimension), np.float32)
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode("utf-8", "replace"))
            out[i, h % dimension] += 1.0 if h >> 31 else -1.0
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(length, 1e-12)


def encode(texts: DataFrame, encoder: Callable[[list[str]], np.ndarray] = hashed_bag, column: str = "text", dimension: int = DIMENSION, batch: int = 32, failures=None) -> DataFrame:
    """``embedding`` of a text column, in batches; a batch that the encoder fails on gets zero vectors. ``failures``, an accumulator of the session,
    counts its texts, and the worker's log names the error."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out: list = []
            for at in range(0, len(s), batch):
                rows = s.iloc[at : at + batch].fillna("").tolist()
                try:
                    out += list(encoder(rows))
                except Exception:
                    logging.getLogger(__name__).exception("%d texts get zero vectors", len(rows))
                    if failures is not None:
                        failures.add(len(rows))
                    out += [np.zeros(dimension, np.float32)] * len(rows)
            yield pd.Series(out)

    return texts.withColumn("embedding", run(F.col(column)))


def upsert(vectors: DataFrame, new: DataFrame) -> DataFrame:
    return vectors.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)


def remove(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids, "id", "left_anti")


def clear(vectors: DataFrame) -> DataFrame:
    """A table of no vectors."""
    return vectors.limit(0)
