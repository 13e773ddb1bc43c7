"""Keywords of a text and suggestions of notes to link."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marginalia.functions.text import keyword_matches, match_text, preview
from marginalia.operators.vectors import in_blocks
from marginalia.scratch import saved
from marginalia.session import ship

BASE, SPAN = 0.3, 0.3
#: Texts whose keywords are broadcast at once.
FEW_TEXTS = 2000
#: Different keywords that are broadcast at once; more go in blocks.
FEW_WORDS = 500_000
#: Notes, first in the order of id, in which the holders of common keywords are looked for.
FIRST_NOTES = 2000


def keywords(texts: DataFrame, top: int = 10) -> DataFrame:
    """(query_id, keyword, count, rank): the most frequent keywords of each (query_id, text), equal counts in the order of first use."""
    found = texts.select("query_id", F.posexplode(keyword_matches(F.col("text"))).alias("pos", "keyword")).groupBy("query_id", "keyword").agg(F.count(F.lit(1)).alias("count"), F.min("pos").alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc("count"), "first")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "keyword", "count", "rank")


def matched(words: Column, text: Column) -> Column:
    return F.filter(words, lambda w: F.contains(text, w))


def first_holders(lists: DataFrame, notes: DataFrame, first: int) -> DataFrame:
    """(query_id, id): of (query_id, words), the ``first`` notes (id, text) in the order of id that hold a keyword of the query.

    These are among the first notes of each single keyword, so of each task only the first notes of a keyword move on.
    """
    pairs = lists.select("query_id", F.explode("words").alias("word"))
    words = saved(pairs.select("word").distinct())

    def ranked(df: DataFrame, key: str) -> DataFrame:
        return df.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("id"))).filter(F.col("n") <= first).drop("n")

    def holders(notes: DataFrame, words: DataFrame) -> DataFrame:
        return ranked(reduce(DataFrame.unionByName, [_holders(notes, block) for block in in_blocks(words, FEW_WORDS, "word")]), "word")

    # Keywords of very many notes find theirs among the first notes; the others go on to all.
    begin = saved(holders(notes.orderBy("id").limit(FIRST_NOTES), words))
    done = begin.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= first).select("word")
    rare = saved(words.join(done, "word", "left_anti"))
    found = saved(begin.join(done, "word", "left_semi").unionByName(holders(notes, rare)))
    return saved(ranked(pairs.join(found, "word").select("query_id", "id").distinct(), "query_id"))


def _holders(notes: DataFrame, words: DataFrame) -> DataFrame:
    """(word, id) of the notes (id, text) that hold a keyword. A keyword is of word characters or of CJK characters alone, so it lies within a run of
    such; parts of a run are looked up in the set of keywords, once for each different run of a batch."""
    spark = notes.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(frozenset(words.toArrow().column("word").to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        sizes = sorted({len(w) for w in wanted})
        runs = re.compile("[a-zA-Z0-9_]+|[一-鿿]+")
        for b in batches:
            known: dict[str, set] = {}
            rows, held = [], []
            for n, text in enumerate(b.column(1).to_pylist()):
                own: set = set()
                for r in set(runs.findall(text or "")):
                    if (parts := known.get(r)) is None:
                        parts = known[r] = {r[i : i + m] for m in sizes if m <= len(r) for i in range(len(r) - m + 1)} & wanted
                    own |= parts
                rows += [n] * len(own)
                held += own
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string()), b.column(0).take(pa.array(rows, pa.int64()))], names=["word", "id"])

    return notes.select("id", "text").mapInArrow(run, StructType([words.schema["word"], notes.schema["id"]]))


def suggest(texts: DataFrame, notes: DataFrame, semantic: DataFrame, k: int = 5, threshold: float = 0.6, exclude: DataFrame | None = None, top_keywords: int = 10) -> DataFrame:
    """(query_id, id, score, match_type, matched_keywords, preview, rank) of notes to link from each (query_id, text).

    ``semantic``: hits (query_id, id, score, rank) of a search by cosine, those of at least ``threshold`` count. Other notes count by the share of
    keywords that they hold, 0.3 + 0.3 share, from half the threshold on, and are taken in the order of id while there are less than 2k. The
    k best are given, equal scores semantic ones first.
    """
    if exclude is not None:
        notes = notes.join(exclude.select("id"), "id", "left_anti")
        semantic = semantic.join(exclude.select("id"), "id", "left_anti")
    near = semantic.filter((F.col("rank") <= 2 * k) & (F.col("score") >= threshold)).select("query_id", "id", F.round("score", 3).alias("score"), F.lit("semantic").alias("match_type"), F.lit(None).cast("array<string>").alias("matched_keywords"), F.col("rank").alias("place"))
    lists = keywords(texts, top_keywords).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "keyword"))), lambda x: x["keyword"]).alias("words"))
    lists = saved(lists)
    own = notes.select("id", match_text(F.col("title"), F.col("tags"), F.col("content")).alias("text"))
    share = lambda m: F.lit(BASE) + F.lit(SPAN) * m / F.size("words")
    one = share(F.lit(1)) >= threshold * 0.5
    # Where one keyword is enough, the first notes of each keyword hold the first notes of each text: 2k, and up to 2k that are near.
    held = [first_holders(lists.filter(one), own, 4 * k).join(lists, "query_id").join(own, "id")]
    # Where it takes more, blocks of texts meet all notes; each row gives the words it holds, so nothing but matches leaves the task.
    rest = lists.filter(~one)
    if not rest.isEmpty():
        held += [own.join(F.broadcast(q), how="cross") for q in in_blocks(rest, FEW_TEXTS)]
    held = reduce(DataFrame.unionByName, [h.select("query_id", "id", "words", matched(F.col("words"), F.col("text")).alias("matched_keywords")) for h in held])
    scored = held.withColumn("raw", share(F.size("matched_keywords")))
    passed = scored.filter((F.size("matched_keywords") > 0) & (F.col("raw") >= threshold * 0.5)).join(near.select("query_id", "id"), ["query_id", "id"], "left_anti")
    have = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("have"))
    order = Window.partitionBy("query_id").orderBy("id")
    taken = passed.withColumn("n", F.row_number().over(order)).join(have, "query_id", "left").filter(F.col("n") <= 2 * k - F.coalesce("have", F.lit(0)))
    words = taken.select("query_id", "id", F.round("raw", 3).alias("score"), F.lit("keyword").alias("match_type"), "matched_keywords", (F.col("n") + 1_000_000).alias("place"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "place")
    ranked = near.unionByName(words).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("place")
    return ranked.join(notes.select("id", preview(F.col("content"), 150, True).alias("preview")), "id")
