"""The corpus pipeline: its stages in order, and one call that applies them to documents.

Each stage is a function of (session, documents, folder of the tables) and works on all that its predecessor kept. All but the last return the
columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import chosen_path, compact_windows, exact_dedup, packing, quality
from marginalia.llm.common import saved, table

STAGES = [
    ("quality classifier", quality.stage),
    ("exact dedup", exact_dedup.stage),
    ("n-gram Jaccard join", chosen_path.stage),
    ("substring dedup", compact_windows.stage),
    ("packing", packing.stage),
]

#: Trained models and tokenizer ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn; each intermediate result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs, name.replace(" ", "_"))
    return docs
