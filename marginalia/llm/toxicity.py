"""Toxicity by a classifier chain.

A bounded sample of labelled documents (SAMPLE rows of each kind, those with the smallest hash of doc_id) gives the terms, words and word
beginnings, that tell toxic documents from others. The chain predicts categories one after the other: "named" (whole words that mark toxic
texts), "coded" (word beginnings with many endings), "dense" (many marks for its length), and last "toxic" itself. Each link is a logistic
model over the terms and the probabilities of the earlier links; in training these are out-of-fold predictions, so that later links do not learn
from probabilities that have seen the label.

Results: null and empty texts are scored like any other text; without labels of both kinds all probabilities are the mean label, 0 without
labels; repeated rows give repeated rows; an empty table gives no rows. Only doc_id and text are read for scoring.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import table, text_of
from marginalia.llm.quality import held_out

SAMPLE, TERMS, FOLDS, STEPS = 2500, 512, 3, 150
#: Lengths of the word beginnings that are terms.
BEGINNINGS = (4, 5, 6, 7)
CHAIN = ("named", "coded", "dense", "toxic")
THRESHOLD = 0.6
#: A term must occur in so many of the toxic texts, and its logarithm of odds between toxic and other texts must be so large.
SUPPORT, CLEAR = 0.02, 2.5
CACHED = 300_000

_word = re.compile(r"\w+")


def marks(chunk: str) -> list[str]:
    """Terms of a chunk between white space: its words, and the beginnings of longer ones."""
    out = []
    for w in _word.findall(chunk.lower()):
        out.append(w[:64])
        out += [w[:n] + "*" for n in BEGINNINGS if len(w) > n]
    return out


def family(text: str) -> int:
    """The smallest hash of five words in a row: copies and near copies of a text mostly share it, and count once in training."""
    words = _word.findall(text.lower())
    return min((zlib.crc32(" ".join(words[i : i + 5]).encode("utf-8", "replace")) for i in range(max(1, len(words) - 4))), default=0)


class Logistic:
    """A linear model fitted by Adam on the whole batch with a ridge penalty; both answers weigh the same in all."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = STEPS):
        w = np.zeros(x.shape[1] + 1, np.float32)
        share = (y.sum() + 0.5) / (len(y) + 1)
        weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / len(y)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):
            p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            e = ((p - y) * weight).astype(np.float32)
            g = np.append(x.T @ e, e.sum()).astype(np.float32)
            g[:-1] += ridge * w[:-1]
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        self.w = w

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.w[:-1] + self.w[-1], -30, 30)))


class Chain:
    def __init__(self, texts: list[str], toxic: list[int], n_terms: int = TERMS):
        families: set = set()
        once = [families.add(f) or i for i, (t, k) in enumerate(zip(texts, toxic, strict=True)) if (f := (k, family(t))) not in families]
        texts, toxic = [texts[i] for i in once], [toxic[i] for i in once]
        y = np.array(toxic, np.float32)
        self.prior = float(y.mean()) if len(y) else 0.0
        self.index: dict[str, int] = {}
        self.links: list[Logistic] = []
        self.seen: dict[str, tuple] = {}
        if len(set(toxic)) < 2:
            return
        found: list[Counter] = [Counter(), Counter()]
        endings: dict[str, set] = {}
        for text, t in zip(texts, toxic, strict=True):
            own = {m for c in set(text.split()) for m in marks(c)}
            found[t].update(own)
        n = [len(y) - int(y.sum()), int(y.sum())]
        odds = {m: np.log((k + 0.5) / (n[1] + 1)) - np.log((found[0][m] + 0.5) / (n[0] + 1)) for m, k in found[1].items() if k >= max(3, SUPPORT * n[1])}
        gain = {m: (found[1][m] / n[1] - found[0][m] / n[0]) * odds[m] for m in odds}
        best = sorted((m for m in gain if odds[m] > CLEAR), key=lambda m: (-gain[m], m))[:n_terms] or sorted(gain, key=lambda m: (-gain[m], m))[:n_terms]
        self.index = {m: i for i, m in enumerate(best)}
        for m in found[1]:
            for b in () if m.endswith("*") else {m[:n] + "*" for n in BEGINNINGS}.intersection(self.index):
                endings.setdefault(b, set()).add(m)
        strong = set(best)
        coded = {m for m in strong if m.endswith("*") and len(endings.get(m, ())) >= 5}
        self.strong = np.array([m in strong for m in best], bool)
        x, counts = self.features(texts)
        is_coded = np.array([m in coded for m in best], bool)
        is_named = np.array([m in strong and not m.endswith("*") and coded.isdisjoint(m[:k] + "*" for k in BEGINNINGS) for m in best], bool)
        rate = counts[:, self.strong].sum(1) / np.maximum(1, [len(t.split()) for t in texts])
        middle = np.median(rate[y == 1]) if n[1] else 0
        goals = [y * (x[:, : len(best)][:, is_named].sum(1) > 0), y * (x[:, : len(best)][:, is_coded].sum(1) > 0), y * (rate > middle), y]
        fold = np.arange(len(y)) % FOLDS
        for goal in goals:
            inner = np.empty(len(y), np.float32)
            for f in range(FOLDS):
                inner[fold == f] = Logistic(x[fold != f], goal[fold != f])(x[fold == f])
            self.links.append(Logistic(x, goal))
            x = np.column_stack([x, inner])

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logarithmic counts of the terms and of the number of different strong ones, and the terms' counts."""
        counts = np.zeros((len(texts), len(self.index)), np.float32)
        seen, get = self.seen, self.index.get
        if len(seen) > CACHED:
            seen.clear()
        for i, text in enumerate(texts):
            chunks = text.split()
            for c in set(chunks).difference(seen):
                seen[c] = tuple(j for m in marks(c) if (j := get(m)) is not None)
            for hit in filter(None, map(seen.__getitem__, chunks)):
                for j in hit:
                    counts[i, j] += 1
            for c in [c for c in set(chunks) if len(c) > 256]:
                seen.pop(c, None)
        x = np.log1p(counts)
        return np.column_stack([x, np.log1p((counts[:, self.strong] > 0).sum(1))]), counts

    def scores(self, texts: list[str]) -> np.ndarray:
        """A column of probabilities for each link, the chain's order."""
        if not self.links:
            return np.full((len(texts), len(CHAIN)), self.prior)
        out = []
        for at in range(0, len(texts), 256):
            x, _ = self.features(texts[at : at + 256])
            for link in self.links:
                x = np.column_stack([x, link(x)])
            out.append(x[:, -len(CHAIN) :])
        return np.concatenate(out) if out else np.zeros((0, len(CHAIN)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    order = F.xxhash64(F.col("doc_id").cast("long"))
    own = labels.filter(F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).filter(~held_out()).dropDuplicates(["doc_id"])
    chosen = own.filter("label = 1").orderBy(order, "doc_id").limit(sample).unionByName(own.filter("label = 0").orderBy(order, "doc_id").limit(sample))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").orderBy(order, "doc_id", "text").limit(2 * sample).collect()
    return Chain([r["text"] for r in rows], [r["label"] for r in rows])


def toxicity(docs: DataFrame, chain: Chain) -> DataFrame:
    """One row per document: doc_id, p_named, p_coded, p_dense, score (of the last link) and predicted."""
    chain.seen = {}
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    @F.pandas_udf(", ".join(f"p_{c} double" for c in CHAIN))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame(shared.value.scores(s.tolist()), columns=[f"p_{c}" for c in CHAIN])

    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(text_of()).alias("p"))
    return got.select("doc_id", *(f"p.p_{c}" for c in CHAIN[:-1]), F.col(f"p.p_{CHAIN[-1]}").alias("score"), (F.col(f"p.p_{CHAIN[-1]}") >= THRESHOLD).cast("int").alias("predicted"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
