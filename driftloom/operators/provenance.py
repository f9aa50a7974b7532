"""Fingerprints, histories and upserts of issues; validity of cached rows.

Keys compare nulls as equal where rows are grouped; a null key joins nothing. Empty tables give empty results, but for
``repo_fingerprint``, which has one row of zeros. Equal rows count once in an upsert.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def message_form(message: Column) -> Column:
    """A message without its numbers, quoted parts and Python paths; null is empty."""
    form = F.regexp_replace(F.coalesce(message, F.lit("")), r"[0-9]+", "N")
    form = F.regexp_replace(form, r'"[^"]*"', '""')
    form = F.regexp_replace(form, r"'[^']*'", "''")
    return F.regexp_replace(form, r"/[^\s]*\.py", "/PATH.py")


def fingerprints(issues: DataFrame, message: str, evidence: Column | None = None) -> DataFrame:
    """Issues with content_hash (kind, message form, evidence as JSON), location_hash (file, line) and issue_id."""
    proof = F.coalesce(evidence, F.lit("{}")) if evidence is not None else F.lit("{}")
    content = F.sha2(F.concat(F.coalesce("kind", F.lit("")), F.lit("|"), message_form(F.col(message)), F.lit("|"), proof), 256)
    place = F.sha2(F.concat(F.coalesce("file", F.lit("")), F.lit("|"), F.coalesce("line", F.lit(0)).cast("string")), 256)
    hashed = issues.withColumns({"content_hash": F.substring(content, 1, 16), "location_hash": F.substring(place, 1, 8)})
    return hashed.withColumn("issue_id", F.concat_ws("_", F.lit("TC"), F.coalesce("kind", F.lit("")), "content_hash", "location_hash"))


def upsert(rows: DataFrame, key: str, updated: str, arrival: str) -> DataFrame:
    """The newest row of each key, the last by arrival of equals."""
    newest = Window.partitionBy(key).orderBy(F.col(updated).desc(), F.col(arrival).desc())
    return rows.withColumn("nth", F.row_number().over(newest)).where("nth = 1").drop("nth")


def similar(prints: DataFrame) -> DataFrame:
    """Issues whose content others have too: how many, and the first id of the content. Linear where all pairs would be square."""
    groups = prints.select("issue_id", "content_hash").distinct().groupBy("content_hash").agg(F.count("*").alias("n"), F.min("issue_id").alias("first_id"))
    own = prints.select("issue_id", "content_hash").distinct()
    return own.join(groups.where("n > 1"), "content_hash").select("issue_id", "content_hash", (F.col("n") - 1).alias("similar"), "first_id")


def history(events: DataFrame) -> DataFrame:
    """Events (issue_id, event, ts, event_id) of each issue: count, first, last, and whether the last one resolved it."""
    last = F.max_by("event", F.struct("ts", "event_id"))
    return events.groupBy("issue_id").agg(
        F.count("*").alias("events"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), (last == "resolved").alias("resolved"),
        F.count_if(F.col("event") == "regressed").alias("regressions"),
    )


def process(current: DataFrame, stored: DataFrame, events: DataFrame) -> DataFrame:
    """Issues of a run against what was stored before it: new, regressed (its last event resolved it) or known."""
    ids = current.select("issue_id").distinct()
    known = stored.select("issue_id").distinct().withColumn("stored", F.lit(True))
    joined = ids.join(known, "issue_id", "left").join(history(events).select("issue_id", "resolved"), "issue_id", "left")
    status = F.when(F.col("stored").isNull(), "new").when(F.coalesce("resolved", F.lit(False)), "regressed").otherwise("known")
    return joined.select("issue_id", status.alias("status"))


def merge_absent(index: DataFrame, shard: DataFrame, key: str) -> DataFrame:
    """The index and those shard rows whose key it lacks."""
    return index.unionByName(shard.join(index.select(key), key, "left_anti"))


def validity(now: DataFrame, cached: DataFrame, key: str, facts: Sequence[str]) -> DataFrame:
    """Current rows against cached facts: valid if all are equal, else stale; missing if not cached."""
    old = cached.select(F.col(key), *[F.col(c).alias(f"cached_{c}") for c in facts], F.lit(True).alias("in_cache"))
    same = F.lit(True)
    for c in facts:
        same = same & F.col(c).eqNullSafe(F.col(f"cached_{c}"))
    state = F.when(F.col("in_cache").isNull(), "missing").when(same, "valid").otherwise("stale")
    return now.join(old, key, "left").select(key, state.alias("state"))


def changed_since(now: DataFrame, cached: DataFrame, key: str, mtime: str) -> DataFrame:
    """Rows that changed after they were cached; those never cached count from time 0."""
    old = cached.select(F.col(key), F.col(mtime).alias("cached_mtime"))
    return now.join(old, key, "left").where(F.col(mtime) > F.coalesce("cached_mtime", F.lit(0))).drop("cached_mtime")


def repo_fingerprint(files: DataFrame, path: str, facts: Sequence[str]) -> DataFrame:
    """One digest of all files, whatever their order and number: an exclusive or of row hashes, so no list is gathered."""
    row = F.concat_ws("|", F.col(path), *[F.col(c).cast("string") for c in facts])
    part = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("bigint")
    return files.agg(F.count("*").alias("files"), F.coalesce(F.bit_xor(part), F.lit(0)).alias("digest"))


def reusable(stored: DataFrame, current: DataFrame, facts: Sequence[str]) -> DataFrame:
    """One row ``reusable``: a stored artefact has all of the current one's facts (schema, root, fingerprints)."""
    pairs = stored.select(*facts).distinct().withColumn("hit", F.lit(1))
    both = current.select(*facts).distinct().join(pairs, list(facts), "left")
    return both.agg((F.coalesce(F.max("hit"), F.lit(0)) == 1).alias("reusable"))
