"""Notes in Markdown files with YAML front matter."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.schema import NOTE_TYPES, NOTES
from marginalia.session import ship

# Fixed value: where the front matter of a note ends.
FRONT = r"(?s)^---\n(.*?)\n---\n+(.*)"
PARSED = "id string, title string, content string, type string, created timestamp_ntz, updated timestamp_ntz, tags array<string>, links array<string>, backlinks array<string>, source string, filepath string, problem string"


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(filepath, raw, size) of all Markdown files below a folder, or of some files. Spark's sources leave out files of no bytes; ``checked`` lists those too."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(path)
    return found.select(F.col("path").alias("filepath"), F.col("content").alias("raw"), F.col("length").alias("size"))


def parse(raw: bytes, with_body: bool = True) -> dict:
    """Fields of a note file, or its ``problem``. Metadata alone may begin with a byte-order mark and ends within 200 lines; a full note has no
    mark. Lists that aren't lists are empty; an unknown type is a problem."""
    import yaml

    try:
        text = raw.decode("utf-8-sig" if not with_body else "utf-8")
    except UnicodeDecodeError as e:
        return {"problem": f"encoding: {e.reason}"}
    text = text.replace("\r\n", "\n")
    found = re.match(FRONT, text) if with_body else re.match(r"(?s)^---\n(.*?)\n---(?:\n|$)", text)
    if not found or (not with_body and found.group(1).count("\n") >= 200):
        return {"problem": "no front matter"}
    try:
        own = yaml.safe_load(found.group(1))
    except yaml.YAMLError:
        return {"problem": "invalid front matter"}
    if not isinstance(own, dict):
        return {"problem": "invalid front matter"}
    out = {c: None for c in NOTES.names if c != "filepath"}
    body = found.group(2) if with_body else ""
    heading = re.search(r"(?m)^# (.+)$", body)
    out["id"] = str(own.get("id", ""))
    out["title"] = str(own["title"]) if own.get("title") is not None else heading.group(1) if heading else "Untitled"
    out["type"] = own.get("type", NOTE_TYPES[0])
    if out["type"] not in NOTE_TYPES:
        return {"problem": f"type {out['type']!r}"}
    for c in ("tags", "links", "backlinks"):
        out[c] = [str(x) for x in own[c]] if isinstance(own.get(c), list) else []
    for c in ("created", "updated"):
        v = own.get(c)
        try:
            out[c] = v if isinstance(v, datetime) else datetime.fromisoformat(str(v)) if v else None
        except ValueError:
            return {"problem": f"{c}: {v!r}"}
        if out[c] is not None:
            out[c] = out[c].replace(tzinfo=None)
    out["source"] = own.get("source") and str(own["source"])
    out["content"] = re.sub(r"^# .+\n+", "", body, count=1).strip() if with_body else None
    return out


def notes(found: DataFrame, with_body: bool = True) -> DataFrame:
    """All files as notes with a ``problem``, null for good ones; a missing time is the current one."""
    ship(found.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PARSED.split(", ")]
        for b in batches:
            rows = [parse(bytes(raw), with_body) | {"filepath": path} for path, raw in zip(b["filepath"], b["raw"], strict=True)]
            yield pd.DataFrame([{c: r.get(c) for c in names} for r in rows], columns=names)

    parsed = found.select("filepath", "raw").mapInPandas(run, PARSED)
    now = F.localtimestamp()
    good = F.col("problem").isNull()
    return parsed.withColumn("created", F.when(good, F.coalesce("created", now))).withColumn("updated", F.when(good, F.coalesce("updated", now)))


def valid(parsed: DataFrame) -> DataFrame:
    return parsed.filter("problem is null").drop("problem")


def invalid(parsed: DataFrame) -> DataFrame:
    return parsed.filter("problem is not null").select("filepath", "problem")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(filepath, size) of all Markdown files below a folder, through Hadoop's file system, with those of no bytes."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found, walk = [], fs.listFiles(top, True)
    while walk.hasNext():
        f = walk.next()
        if f.getPath().getName().endswith(".md"):
            found.append((f.getPath().toString(), f.getLen()))
    return spark.createDataFrame(found, "filepath string, size long")


def checked(spark: SparkSession, path: str) -> DataFrame:
    """(filepath, issue, size): files that are "empty" or "corrupt"."""
    sizes = listing(spark, path)
    bad = invalid(notes(files(spark, path))).select("filepath", F.lit("corrupt").alias("issue")).join(sizes, "filepath")
    return bad.unionByName(sizes.filter("size = 0").select("filepath", F.lit("empty").alias("issue"), "size"))


def delete_empty(spark: SparkSession, path: str) -> list[str]:
    """Delete the files of no bytes below a folder; the paths that are gone."""
    jvm, gone = spark._jvm, []
    for r in checked(spark, path).filter("issue = 'empty'").toLocalIterator():
        p = jvm.org.apache.hadoop.fs.Path(r["filepath"])
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, False):
            gone.append(r["filepath"])
    return gone


def strip_front_matter(raw: str) -> str:
    """The body of a content file: without byte-order mark, front matter and first heading; a text without front matter as it is."""
    raw = raw.removeprefix("﻿")
    found = re.match(FRONT, raw)
    return re.sub(r"^#[ \t]+\S.*\n*", "", found.group(2).strip()).strip() if found else raw
