"""Links between notes: wiki-link resolution, edges, backlinks, references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import wiki_links
from marginalia.scratch import saved

#: Different link texts that the last tier may broadcast; more meet the titles by their first characters.
FEW_LINKS = 2000


def extract(notes: DataFrame) -> DataFrame:
    """(id, pos, link) of the wiki links in the contents."""
    return notes.select("id", F.posexplode(wiki_links(F.col("content"))).alias("pos", "link"))


def resolve(texts: DataFrame, notes: DataFrame) -> DataFrame:
    """(link, target, tier) of different link texts: an id, else a title without case, else a part of a title; the smallest id of equals.

    The first two tiers are equi joins. Only texts that they leave are compared with parts of titles: by a broadcast of the texts when they are
    few, else by an equi join on the rarest three characters of each text.
    """
    links = texts.select("link").filter(F.coalesce(F.col("link"), F.lit("")) != "").distinct()
    titles = notes.select("id", F.lower("title").alias("title"))
    by_id = links.join(titles.select(F.col("id").alias("link"), F.col("id").alias("target")).distinct(), "link").withColumn("tier", F.lit(1))
    left = links.join(by_id, "link", "left_anti")
    first = titles.groupBy("title").agg(F.min("id").alias("target"))
    by_title = left.withColumn("title", F.lower("link")).join(first, "title").select("link", "target").withColumn("tier", F.lit(2))
    left = left.join(by_title, "link", "left_anti").withColumn("low", F.lower("link"))
    if left.limit(FEW_LINKS + 1).count() <= FEW_LINKS:
        inside = titles.join(F.broadcast(left), F.contains(F.col("title"), F.col("low")))
    else:
        pieces = lambda c: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.array(*(F.substring(F.col(c), i, F.lit(n)) for n in (1, 2, 3))))))
        grams = saved(titles.filter(F.length("title") > 0).select("id", "title", F.explode(pieces("title")).alias("gram")))
        # Each text waits at the rarest of its longest pieces; one that no title has tells that there is nothing to find.
        many = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("m"))
        own = left.withColumn("gram", F.explode(F.filter(pieces("low"), lambda g: F.length(g) == F.least(F.lit(3), F.length("low")))))
        rarest = own.join(many, "gram", "left").groupBy("link", "low").agg(F.min_by("gram", F.struct(F.coalesce("m", F.lit(0)), "gram")).alias("gram"))
        inside = grams.join(rarest, "gram").filter(F.contains(F.col("title"), F.col("low")))
    by_part = inside.groupBy("link").agg(F.min("id").alias("target")).withColumn("tier", F.lit(3))
    return by_id.unionByName(by_title).unionByName(by_part)


def edges(notes: DataFrame) -> DataFrame:
    """(src, dst, type), unique by src and dst: declared links to notes that exist, then wiki links where no edge is yet."""
    ids = notes.select(F.col("id").alias("dst"))
    declared = notes.select(F.col("id").alias("src"), F.explode("links").alias("dst")).join(ids, "dst", "left_semi").select("src", "dst", F.lit("links").alias("type"))
    found = saved(extract(notes).select("id", "link"))  # read several times, and small beside the contents
    wiki = found.join(resolve(found, notes), "link").select(F.col("id").alias("src"), F.col("target").alias("dst"), F.lit("wiki_link").alias("type"))
    return declared.unionByName(wiki).groupBy("src", "dst").agg(F.min("type").alias("type"))


def backlinks(notes: DataFrame) -> DataFrame:
    """(id, backlinks): sorted sources of the declared links to a note."""
    return notes.select(F.explode("links").alias("id"), F.col("id").alias("src")).join(notes.select("id"), "id", "left_semi").groupBy("id").agg(F.sort_array(F.collect_set("src")).alias("backlinks"))


def broken(notes: DataFrame) -> DataFrame:
    """(id, missing): declared links without a note, in their order."""
    out = notes.select(F.col("id").alias("src"), F.posexplode("links").alias("pos", "link")).join(notes.select(F.col("id").alias("link")), "link", "left_anti")
    return out.groupBy(F.col("src").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "link"))), lambda x: x["link"]).alias("missing"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, added, removed) links of notes in both."""
    both = old.select("id", F.col("links").alias("old")).join(new.select("id", F.col("links").alias("new")), "id")
    return both.select("id", F.sort_array(F.array_except("new", "old")).alias("added"), F.sort_array(F.array_except("old", "new")).alias("removed"))


def refs(notes: DataFrame) -> DataFrame:
    """(id, title, outgoing, incoming) counts of declared links and stored backlinks."""
    size = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>")))
    return notes.select("id", "title", size("links").alias("outgoing"), size("backlinks").alias("incoming"))


def refs_of(notes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, direction, pos, other, title) of links and backlinks of some notes; those whose note is gone are dropped."""
    own = notes.join(F.broadcast(ids) if ids.limit(10_001).count() <= 10_000 else ids, "id", "left_semi")
    both = own.select("id", F.lit("forward").alias("direction"), F.posexplode("links").alias("pos", "other")).unionByName(own.select("id", F.lit("backward").alias("direction"), F.posexplode("backlinks").alias("pos", "other")))
    return both.join(notes.select(F.col("id").alias("other"), "title"), "other").select("id", "direction", "pos", "other", "title")


def find(notes: DataFrame, title: str, how: str = "part") -> DataFrame:
    """Notes whose title has, begins with ("prefix") or is ("exact") a text, without case."""
    low = F.lower("title")
    test = {"part": F.contains(low, F.lit(title.lower())), "prefix": F.startswith(low, F.lit(title.lower())), "exact": low == title.lower()}
    return notes.filter(test[how])


def first_per(df: DataFrame, key: str, *order) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")
