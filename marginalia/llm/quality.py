"""Quality by nearest-neighbour voting in a latent-semantic space.

A bounded sample of labelled documents (SAMPLE rows, those with the smallest hash of doc_id) is turned into term vectors: words, word shapes and
coarse statistics of repetition, case, symbols and lines. A truncated singular value decomposition of that sample gives the latent space; the
labelled vectors (SAMPLE x DIMENSIONS numbers) are broadcast. Every document is projected, exact cosines with all labelled vectors are computed
block by block, and the NEIGHBOURS nearest vote with their similarity as weight; neighbours as near as the last one all vote.

Results: null and empty texts are scored like any other text; without labels of both kinds the score is the mean label, or 1 without labels;
repeated rows give repeated rows; an empty table gives no rows. Inputs of a score are the text alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import process_state, table, text_of, unused

SAMPLE, DIMENSIONS, NEIGHBOURS, BLOCK = 5000, 64, 15, 256
POWER, THRESHOLD = 4.0, 0.3
#: Weight of a statistic beside the unit vectors of words and shapes.
STAT = 1.5
WORDS, SHAPES, STATS = 2048, 256, 96
WIDTH = WORDS + SHAPES + STATS
CACHED = 100_000

_edge = re.compile(r"[^\w]+$")
_letters = re.compile(r"[^\W\d_]")


def _code(chunk: str) -> int:
    """Packed: the word's bucket, the bucket of its shape (case and closing symbols), whether it is all capitals, letters and characters."""
    closing = m.group() if (m := _edge.search(chunk)) else ""
    word = chunk[: len(chunk) - len(closing)]
    upper = word.isupper() and len(word) > 1
    case = "U" if upper else "l" if word.islower() else "T" if word.istitle() else "0" if word.isdigit() else "-" if not word else "m"
    bucket, shape = (zlib.crc32(x.encode("utf-8", "replace")) for x in (word.lower(), f"{case}{closing[:4]}"))
    return bucket % WORDS | shape % SHAPES << 16 | upper << 32 | min(len(_letters.findall(chunk)), 255) << 40 | min(len(chunk), 255) << 48


def codes(chunks: list[str]) -> np.ndarray:
    known = process_state("quality", dict)
    if len(known) > CACHED:
        known.clear()
    out = list(map(known.get, chunks))
    if None in out:
        for i, c in enumerate(out):
            if c is None:
                code = known.get(chunks[i])
                out[i] = code = _code(chunks[i]) if code is None else code
                if len(chunks[i]) <= 256:
                    known[chunks[i]] = code
    return np.array(out, np.int64)


#: Edges of the 12 bins of a share from 0 to 1, finer at both ends.
BINS = np.array((0.005, 0.02, 0.06, 0.12, 0.25, 0.4, 0.6, 0.75, 0.88, 0.94, 0.98))


def terms(text: str) -> np.ndarray:
    """The term vector: logarithmic counts of words and of shapes, each of unit length, and one bin of each of eight statistics."""
    out = np.zeros(WIDTH, np.float32)
    chunks = text.split()
    n, lines = len(chunks), [x for x in text.split("\n") if x.strip()]
    same_lines = len(set(lines)) / len(lines) if lines else 0.0
    shares = np.array((0, 1, 0, same_lines, 0, 0, 0, 0), float)
    if n:
        packed = codes(chunks)
        w = np.log1p(np.bincount(packed & 0xFFFF, minlength=WORDS))
        s = np.log1p(np.bincount(packed >> 16 & 0xFFFF, minlength=SHAPES))
        out[:WORDS] = w / np.sqrt(w @ w)
        out[WORDS : WORDS + SHAPES] = s / np.sqrt(s @ s)
        order = np.sort(packed)
        starts = np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1])))
        most = np.diff(np.append(starts, n)).max()
        repeats = (packed[1:] == packed[:-1]).sum() / max(1, n - 1)
        letters, chars = (packed >> 40 & 0xFF).sum(), (packed >> 48).sum()
        shares[:] = len(starts) / n, most / n, repeats, same_lines, letters / max(1, chars), (packed >> 32 & 1).sum() / n, min(1.0, n / 400), min(1.0, len(text) / n / 24)
    out[WORDS + SHAPES + 12 * np.arange(len(shares)) + np.searchsorted(BINS, shares)] = STAT
    return out


def leading_axes(x: np.ndarray, dimensions: int, rounds: int = 8) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed start."""
    q = np.random.default_rng(0).standard_normal((x.shape[1], dimensions + 16)).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :dimensions]


class Neighbours:
    """The labelled vectors and the projection into their space."""

    def __init__(self, texts: list[str], labels: list[int], dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS):
        self.labels = np.array(labels, np.float64)
        self.k = min(neighbours, len(labels))
        if not len(labels):
            return
        x = np.stack([terms(t) for t in texts])
        self.idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
        self.idf[WORDS + SHAPES :] = 1
        x *= self.idf
        self.axes = leading_axes(x, min(dimensions, len(x)))
        self.vectors = self.unit(x @ self.axes)

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def scores(self, texts: list[str]) -> np.ndarray:
        if len(set(self.labels.tolist())) < 2:
            return np.full(len(texts), self.labels.mean() if len(self.labels) else 1.0)
        out = np.empty(len(texts))
        for at in range(0, len(texts), BLOCK):
            x = np.stack([terms(t) for t in texts[at : at + BLOCK]]) * self.idf
            near = self.unit(x @ self.axes) @ self.vectors.T
            last = np.partition(near, near.shape[1] - self.k, axis=1)[:, near.shape[1] - self.k, None]
            weight = np.where(near >= last, np.maximum(near, 1e-6).astype(np.float64) ** POWER, 0.0)
            out[at : at + BLOCK] = weight @ self.labels / weight.sum(1)
        return np.clip(out, 0.0, 1.0)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, column: str, limit: int, learn_only: bool = True) -> list:
    """At most ``limit`` rows (text, label), those with the smallest hash of doc_id; the labels chosen are few enough to be broadcast."""
    order = F.xxhash64(F.col("doc_id").cast("long"))
    own = labels.filter(F.col(column).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    if learn_only:
        own = own.filter(~held_out())
    chosen = own.dropDuplicates(["doc_id"]).orderBy(order, "doc_id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").orderBy(order, "doc_id", "text").limit(limit).collect()


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Neighbours:
    rows = labelled(docs, labels, "quality", sample)
    return Neighbours([r["text"] for r in rows], [r["label"] for r in rows])


def scorer(spark: SparkSession, model: Neighbours):
    """A function of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(shared.value.scores(s.tolist()))

    return score


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    score = scorer(spark, train(docs, table(spark, sf_dir, "labels")))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(text_of()).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    score = scorer(spark, train(docs, table(spark, sf_dir, "labels")))
    own = unused(docs, "_score")
    return docs.withColumn(own, score(text_of())).filter(F.col(own) >= THRESHOLD).drop(own)
