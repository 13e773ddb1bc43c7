"""Listing, maintenance and verification of notes and indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import has_all_tags, id_of_stem
from marginalia.schema import NOTE_TYPES
from marginalia.scratch import saved


def type_rank():
    return F.coalesce(F.array_position(F.array(*map(F.lit, NOTE_TYPES)), F.col("type")), F.lit(9))


def listed(notes: DataFrame, note_type: str | None = None, tags: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Notes by type in the fixed order, newest id first; filters come before the limit; no limit for 0 or None."""
    if note_type is not None:
        notes = notes.filter(F.col("type") == note_type)
    if tags:
        notes = notes.filter(has_all_tags(F.col("tags"), tags))
    ordered = notes.orderBy(type_rank(), F.desc("id"))
    return ordered.limit(limit) if limit else ordered


def metadata(notes: DataFrame) -> DataFrame:
    """Notes without their contents."""
    return notes.drop("content")


def daily(notes: DataFrame, day: str) -> DataFrame:
    """Notes whose id begins with a date, given as yyyy-MM-dd."""
    return notes.filter(F.startswith("id", F.lit(day.replace("-", "")))).orderBy("id")


def inbox(notes: DataFrame, limit: int = 20) -> DataFrame:
    return listed(notes, "fleeting", None, limit)


def status(notes: DataFrame) -> DataFrame:
    """(type, notes) with the total, whose type is null."""
    return notes.rollup("type").agg(F.count(F.lit(1)).alias("notes"))


def verify(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """(id, problem): "missing" from the index or "orphaned" in it, from file name stems and indexed ids."""
    own = files.select(id_of_stem(F.col("stem")).alias("id")).filter("id is not null").distinct()
    there = indexed.select("id").distinct()
    return own.join(there, "id", "left_anti").withColumn("problem", F.lit("missing")).unionByName(there.join(own, "id", "left_anti").withColumn("problem", F.lit("orphaned")))


def verify_counts(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row: files, indexed, missing, orphaned, healthy."""
    found = verify(files, indexed).agg(F.count_if(F.col("problem") == "missing").alias("missing"), F.count_if(F.col("problem") == "orphaned").alias("orphaned"))
    n = files.agg(F.count_distinct(id_of_stem(F.col("stem"))).alias("files")).crossJoin(indexed.agg(F.count_distinct("id").alias("indexed")))  # one row each
    return n.crossJoin(found).withColumn("healthy", (F.col("missing") == 0) & (F.col("orphaned") == 0))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")


def upsert(notes: DataFrame, new: DataFrame) -> DataFrame:
    """Notes with new ones added or in place of those of the same id."""
    return notes.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)


def delete(notes: DataFrame, ids: DataFrame) -> DataFrame:
    """Notes without some; links to them are left and show up as broken."""
    return notes.join(ids.select("id"), "id", "left_anti")


def edit(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """Notes with the non-null fields of (id, title, content, tags, type, source, links); an empty source clears it; backlinks follow the links."""
    own = [c for c in changes.columns if c != "id"]
    both = notes.join(changes.select("id", *(F.col(c).alias(f"_{c}") for c in own)), "id", "left")
    changed = F.lit(False)
    for c in own:
        changed = changed | F.col(f"_{c}").isNotNull()
        both = both.withColumn(c, F.coalesce(f"_{c}", c))
    if "source" in own:
        both = both.withColumn("source", F.when(F.col("_source") == "", F.lit(None)).otherwise(F.col("source")))
    both = both.withColumn("updated", F.when(changed, F.localtimestamp()).otherwise(F.col("updated"))).select(*notes.columns)
    return with_backlinks(both) if "links" in own else both


def with_backlinks(notes: DataFrame) -> DataFrame:
    """Notes with backlinks from all declared links."""
    from marginalia.operators.links import backlinks

    own = backlinks(notes).withColumnRenamed("backlinks", "_b")
    return notes.join(own, "id", "left").withColumn("backlinks", F.coalesce("_b", F.array().cast("array<string>"))).select(*notes.columns)


def import_notes(rows: DataFrame, at: str, note_type: str = "permanent") -> DataFrame:
    """Rows (title, content, tags) as notes: ids are the time ``at`` and a running number of four digits, which carries into the seconds, so that
    ids of any number of rows differ and have 18 digits. The rows are written once, which fixes their numbers; only one row for each part of
    the table passes through one task."""
    own = saved(rows.select("title", "content", "tags", F.monotonically_increasing_id().alias("_n"))).withColumn("_part", F.shiftright("_n", 33))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = own.groupBy("_part").agg(F.count(F.lit(1)).alias("m")).select("_part", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("_base"))
    numbered = own.join(F.broadcast(base), "_part").withColumn("_n", F.col("_base") + F.col("_n").bitwiseAND((1 << 33) - 1))
    stamp = F.to_timestamp(F.lit(at))
    # Without a time zone, so that no hour comes twice.
    second = F.to_timestamp_ntz(F.lit(at)) + F.make_dt_interval(secs=F.floor(F.col("_n") / 10_000))
    return numbered.select(
        F.concat(F.regexp_replace(F.substring(second.cast("string"), 1, 19), "[^0-9]", ""), F.lpad((F.col("_n") % 10_000).cast("string"), 4, "0")).alias("id"),
        F.coalesce("title", F.lit("Untitled")).alias("title"),
        F.coalesce("content", F.lit("")).alias("content"),
        F.lit(note_type).alias("type"),
        stamp.cast("timestamp_ntz").alias("created"),
        stamp.cast("timestamp_ntz").alias("updated"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.array().cast("array<string>").alias("links"),
        F.array().cast("array<string>").alias("backlinks"),
        F.lit(None).cast("string").alias("source"),
    )
