"""Keyword, semantic and hybrid search over notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import has_all_tags, preview
from marginalia.operators import bm25, vectors
from marginalia.scratch import saved

RRF_K = 60


def depth(k: int) -> int:
    """How many hits each arm gives to the fusion."""
    return max(2 * k, 10)


def fuse(semantic: DataFrame, keyword: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two arms (query_id, id, score, rank) to (query_id, id, score, search_mode, rank).

    A query for which one arm is empty gets the other arm with its own scores and mode. Equal scores keep the semantic order first, then that of
    the keywords.
    """
    a = semantic.select("query_id", "id", F.col("rank").alias("sem_rank"), F.col("score").alias("sem_score"))
    b = keyword.select("query_id", "id", F.col("rank").alias("key_rank"), F.col("score").alias("key_score"))
    both = a.join(b, ["query_id", "id"], "full_outer")
    per = Window.partitionBy("query_id")
    both = both.withColumn("n_sem", F.count("sem_rank").over(per)).withColumn("n_key", F.count("key_rank").over(per))
    share = lambda r: F.coalesce(1.0 / (rrf_k + F.col(r)), F.lit(0.0))
    score = F.when(F.col("n_sem") == 0, F.col("key_score")).when(F.col("n_key") == 0, F.col("sem_score")).otherwise(share("sem_rank") + share("key_rank"))
    mode = F.when(F.col("n_sem") == 0, "keyword").when(F.col("n_key") == 0, "semantic").otherwise("hybrid")
    order = per.orderBy(F.desc(F.round("score", 9)), F.asc_nulls_last("sem_rank"), F.asc_nulls_last("key_rank"))
    ranked = both.withColumn("score", score).withColumn("search_mode", mode).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", "id", "score", "search_mode", "rank")


def wanted_notes(notes: DataFrame, note_type: str | None, tags: list[str] | None) -> DataFrame:
    if note_type is not None:
        notes = notes.filter(F.col("type") == note_type)
    return notes.filter(has_all_tags(F.col("tags"), tags)) if tags else notes


def keyword(index: bm25.Index, queries: DataFrame, k: int = 5, notes: DataFrame | None = None, note_type: str | None = None, tags: list[str] | None = None, match_only: bool = False) -> DataFrame:
    """Keyword search. Filters apply before the top k, over the statistics of the whole corpus."""
    if notes is not None and (note_type is not None or tags):
        ids = wanted_notes(notes, note_type, tags).select("id")
        index = bm25.only(index, ids)
    return bm25.search(index, queries, k, match_only)


def hybrid(index: bm25.Index, table: DataFrame, queries: DataFrame, k: int = 5, notes: DataFrame | None = None, note_type: str | None = None, tags: list[str] | None = None, rrf_k: int = RRF_K, compat: bool = False) -> DataFrame:
    """Hybrid search of queries (query_id, text, vector). ``compat``: the type filter applies to the semantic arm only."""
    near = vectors.search(table, queries, depth(k), note_type, tags)
    words = keyword(index, queries, depth(k), notes, None if compat else note_type, tags)
    return fuse(near, words, k, rrf_k)


def search(mode: str, index: bm25.Index, table: DataFrame, queries: DataFrame, k: int = 5, **options) -> DataFrame:
    """(query_id, id, score, search_mode, rank) in the mode "keyword", "semantic", or, like any other, "hybrid"."""
    if mode == "semantic":
        found = vectors.search(table, queries, k, options.get("note_type"), options.get("tags"))
    elif mode == "keyword":
        found = keyword(index, queries, k, options.get("notes"), options.get("note_type"), options.get("tags"))
    else:
        return hybrid(index, table, queries, k, **options)
    return found.select("query_id", "id", "score", F.lit(mode).alias("search_mode"), "rank")


def hydrate(hits: DataFrame, notes: DataFrame) -> DataFrame:
    """Hits with title, type, tags and a preview of their notes; hits whose note is gone are dropped."""
    hits = saved(hits)  # else counting them would run the search
    own = notes.select("id", "title", "type", "tags", preview(F.col("content"), 300).alias("document"))
    return own.join(F.broadcast(hits) if hits.limit(100_001).count() <= 100_000 else hits, "id")
