"""Commits of git repositories as notes."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import strip
from marginalia.schema import COMMITS

#: Ends each commit in the text that ``log_of`` asks git for.
DELIMITER = "---COMMIT-END---"
FORMAT = f"Hash: %H%nSubject: %s%nAuthor: %an%nDate: %ad%n%n%b%n{DELIMITER}"


def log_of(repo: str, limit: int = 50) -> str:
    done = subprocess.run(["git", "-C", repo, "log", f"--format={FORMAT}", "--date=short", f"-{limit}"], capture_output=True, text=True, encoding="utf-8", errors="replace")
    if done.returncode:
        raise ValueError(done.stderr.strip())
    return done.stdout


def commits(logs: DataFrame, delimiter: str = DELIMITER) -> DataFrame:
    """(hash, subject, author, date, body) of the commits in (raw) log texts. A block's header ends at the first blank line; of several lines
    of one field the last counts; blocks without a hash are dropped."""
    cut = logs.select(F.explode(F.split("raw", rf"\Q{delimiter}\E")).alias("block"))
    clean = cut.select(strip(F.col("block")).alias("block")).filter("block <> ''").withColumn("lines", F.split("block", "\n"))
    bare = F.transform("lines", lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))
    end = F.array_position(bare, "")
    head = F.when(end > 0, F.slice(bare, F.lit(1), (end - 1).cast("int"))).otherwise(bare)
    body = F.when(end > 0, F.slice("lines", (end + 1).cast("int"), F.size("lines"))).otherwise(F.array().cast("array<string>"))
    parts = clean.select(head.alias("head"), strip(F.array_join(body, "\n")).alias("body"))

    def field(prefix: str) -> Column:
        own = F.filter("head", lambda x: F.startswith(x, F.lit(prefix)))
        return F.when(F.size(own) > 0, strip(F.substring(F.element_at(own, -1), len(prefix) + 1, 1 << 20))).otherwise("")

    return parts.select(field("Hash:").alias("hash"), field("Subject:").alias("subject"), field("Author:").alias("author"), field("Date:").alias("date"), "body").filter("hash <> ''")


def as_notes(found: DataFrame, repo: str = "unknown") -> DataFrame:
    """Commits as (title, content, tags); blank lines and co-authors are left out of the body."""
    kept = F.filter(F.split("body", "\n"), lambda x: (strip(x) != "") & ~F.startswith(F.lower(strip(x)), F.lit("co-authored-by:")))
    body = strip(F.array_join(kept, "\n"))
    top = F.concat_ws("\n", F.concat(F.lit("Commit: "), F.substring("hash", 1, 7)), F.concat(F.lit("Author: "), "author"), F.concat(F.lit("Date: "), "date"))
    return found.select(F.col("subject").alias("title"), F.when(body != "", F.concat(top, F.lit("\n\n"), body)).otherwise(top).alias("content"), F.array(F.lit(f"source:{repo}"), F.lit("source:git-log")).alias("tags"))


def read(spark: SparkSession, repo: str, limit: int = 50) -> DataFrame:
    """Commits of a local repository. Git runs on the driver; ``limit`` bounds its output."""
    found = commits(spark.createDataFrame([(log_of(repo, limit),)], "raw string"))
    return found.to(COMMITS)
