"""Exported version histories: commit logs, changed files, and line counts, read as text.

A log holds header lines ``hash|author|unix time|message`` (the message may hold bars) followed by ``status<TAB>path`` or
``added<TAB>removed<TAB>path`` lines, and blank lines between commits. Logs are read whole by file, so a file is one exported log;
split long histories into several exports (by month, say) to read them in parallel. Null and empty logs have no commits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Forms of messages that look like repairs of repairs.
SUSPECT = (
    r"fix\s+import", r"add\s+missing", r"rename.*to\s+match", r"fix.*error", r"resolve.*issue", r"temporary", r"temp\s+fix", r"quick\s+fix", r"typo",
    r"oops", r"forgot", r"missing\s+file", r"undefined", r"not\s+found",
)
HEADER = r"^([0-9a-f]{7,40})\|([^|]*)\|([0-9]+)\|(.*)$"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All logs below a folder: one row ``log`` for each file."""
    return spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).withColumnRenamed("value", "log")


def commits(logs: DataFrame, log: str = "log") -> DataFrame:
    """One row per commit: hash, author, at (seconds), message, entries (its file lines)."""
    parts = F.split(F.concat(F.lit("\n"), F.coalesce(F.col(log), F.lit(""))), r"\n(?=[0-9a-f]{7,40}\|)")
    blocks = logs.select(F.explode(F.filter(parts, lambda p: p.rlike("(?s)^[0-9a-f]{7,40}\\|[^|]*\\|[0-9]+\\|"))).alias("b"))
    head, rest = F.substring_index("b", "\n", 1), F.slice(F.split("b", "\n"), F.lit(2), F.size(F.split("b", "\n")))
    group = lambda n: F.regexp_extract(head, HEADER, n)
    entries = F.filter(rest, lambda x: x.contains("\t"))
    return blocks.select(group(1).alias("hash"), group(2).alias("author"), group(3).cast("long").alias("at"), group(4).alias("message"), entries.alias("entries"))


def files(found: DataFrame) -> DataFrame:
    """One row per changed file of a commit: hash, at, status (or null), added, removed, path."""
    rows = found.select("hash", "at", F.explode("entries").alias("e")).withColumn("p", F.split("e", "\t"))
    counted = F.col("p")[0].rlike(r"^(\d+|-)$")
    number = lambda c: F.when(counted, F.try_to_number(c, F.lit("999999999")).cast("long"))
    return rows.select(
        "hash", "at", F.when(~counted, F.substring(F.col("p")[0], 1, 1)).alias("status"), number(F.get("p", F.lit(0))).alias("added"),
        number(F.get("p", F.lit(1))).alias("removed"), F.element_at("p", -1).alias("path"),
    )


def suspicious(message: Column) -> Column:
    """Whether a message matches a suspect form, or is shorter than ten characters and names neither a merge nor a revert; null is not."""
    low = F.lower(F.coalesce(message, F.lit("")))
    short = (F.length(low) < 10) & ~low.rlike("merge|revert")
    return message.isNotNull() & (low.rlike("|".join(SUSPECT)) | short)


def since(found: DataFrame, now: int, days: int = 30) -> DataFrame:
    """Commits of the last ``days`` before ``now`` (seconds)."""
    return found.where(F.col("at") >= now - 86_400 * days)


def lifetimes(changed: DataFrame) -> DataFrame:
    """First and last change of each path: path, created, modified, commits."""
    return changed.groupBy("path").agg(F.min("at").alias("created"), F.max("at").alias("modified"), F.countDistinct("hash").alias("commits"))


def line_totals(changed: DataFrame) -> DataFrame:
    """One row: lines added and removed over all files with counts, and how many files changed."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return changed.agg(zero("added"), zero("removed"), F.countDistinct("path").alias("files"))


def blame(lines: DataFrame, exported: DataFrame) -> DataFrame:
    """Lines (path, line) with the commit and author of an exported blame (path, line, hash, author)."""
    return lines.join(exported.select("path", "line", "hash", "author"), ["path", "line"], "left")
