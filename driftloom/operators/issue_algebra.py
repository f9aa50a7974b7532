"""Filters, unions, rankings and roll-ups of issue rows.

Issues have kind, severity, confidence, file, line and symbol, and an arrival column where order matters. All keys compare
nulls as equal. Empty tables give empty results, or one row of zeros where a whole table is summed up; repeated rows count
as often as they come unless a function says otherwise. Extra columns pass through row-wise functions.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Modifiers that a confidence knows; others change nothing.
MODIFIERS = ("has_docstring", "is_test_file", "has_pragma")
#: Fields of an issue as a record.
RECORD = ("kind", "message", "severity", "file", "line", "column", "end_line", "end_column", "symbol", "evidence", "suggestions", "confidence")


def by_kind(issues: DataFrame, kind: str) -> DataFrame:
    """Issues of one kind."""
    return issues.where(F.col("kind") == kind)


def by_file(issues: DataFrame, file: str) -> DataFrame:
    """Issues of one file; a null file is none."""
    return issues.where(F.col("file") == file)


def at_least(issues: DataFrame, severity: int = 1) -> DataFrame:
    """Issues from a severity up."""
    return issues.where(F.col("severity") >= severity)


def of_kinds(issues: DataFrame, kinds: Iterable[str]) -> DataFrame:
    """Issues of some kinds."""
    return issues.where(F.col("kind").isin(*kinds))


def without_kinds(issues: DataFrame, kinds: Iterable[str]) -> DataFrame:
    """Issues but those of ignored kinds."""
    kinds = list(kinds)
    return issues.where(~F.col("kind").isin(*kinds)) if kinds else issues


def confident(issues: DataFrame, least: float = 0.8) -> DataFrame:
    """Issues from a confidence up."""
    return issues.where(F.col("confidence") >= least)


def records(issues: DataFrame) -> DataFrame:
    """One struct ``issue`` with all fields of ``RECORD``; fields that the frame lacks are null."""
    have = set(issues.columns)
    return issues.select(F.struct(*[(F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in RECORD]).alias("issue"))


def excluded(path: Column, root: str, patterns: Sequence[str]) -> Column:
    """Whether a path lies at or under ``root/pattern`` for any pattern."""
    found = F.lit(False)
    for pattern in patterns:
        found = found | path.startswith(f"{root.rstrip('/')}/{pattern.strip('/')}")
    return found


def allowed(symbol: Column, allow: Iterable[str]) -> Column:
    """Whether a symbol is on a list; a null symbol is not."""
    return F.coalesce(symbol.isin(*allow), F.lit(False))


def adjusted(base: Column, modifiers: Mapping[str, Column]) -> Column:
    """A confidence times the known modifiers, kept within 0 and 1."""
    product = base
    for name, value in modifiers.items():
        if name in MODIFIERS:
            product = product * value
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), product))


def fixable(issues: DataFrame, only: Sequence[str] = (), skip: Sequence[str] = (), suggestions: str | None = None) -> DataFrame:
    """Issues with a kind and a file, of some kinds, not of others; dropped suggestions (null or blank) go, their issues stay."""
    kept = issues.where(F.col("kind").isNotNull() & F.col("file").isNotNull())
    kept = of_kinds(kept, only) if only else kept
    kept = without_kinds(kept, skip)
    return kept.withColumn(suggestions, F.filter(suggestions, lambda s: F.trim(s) != "")) if suggestions else kept


def ordered(issues: DataFrame, key: str, arrival: str) -> DataFrame:
    """Issues in order: severity (highest first), file (then line; nulls first) or kind; equals by arrival."""
    by = {
        "severity": [F.col("severity").desc()],
        "file": [F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(0))],
        "kind": [F.col("kind").asc_nulls_first()],
    }[key]
    return issues.orderBy(*by, arrival)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of several analyses; columns that one lacks are null."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first


def merged(priority: DataFrame, others: DataFrame, arrival: str) -> DataFrame:
    """The first row of each (file, line, kind), priority rows before others, highest severity first."""
    both = priority.withColumn("rank", F.lit(0)).unionByName(others.withColumn("rank", F.lit(1)))
    first = Window.partitionBy("file", "line", "kind").orderBy("rank", arrival)
    return both.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth").orderBy(F.col("severity").desc(), "rank", arrival)


def first_of(rows: DataFrame, keys: Sequence[str], arrival: str) -> DataFrame:
    """The first row by arrival of each key."""
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(arrival)))
    return ranked.where("nth = 1").drop("nth")


def symbol_groups(issues: DataFrame, signature: Column) -> DataFrame:
    """Issues of each signature, or of each symbol where that is null; rows without either drop out."""
    key = F.coalesce(signature, F.col("symbol"))
    return issues.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.count("*").alias("issues"), F.max("severity").alias("worst"))


def blocks_merge(new: DataFrame, change: float, blocking: int = 0, limit: float = 10.0) -> DataFrame:
    """One row ``blocked``: the risk grew by more than ``limit``, a new issue has severity 4 or more, or something blocks by name."""
    worst = F.coalesce(F.max("severity"), F.lit(0))
    return new.agg((F.lit(change > limit) | (worst >= 4) | F.lit(blocking > 0)).alias("blocked"))


def statistics(issues: DataFrame) -> DataFrame:
    """One row of severity buckets, files, kinds, and the highest and mean confidence (0 without issues)."""
    band = lambda rule: F.count_if(rule)
    return issues.agg(
        F.count("*").alias("issues"), band(F.col("severity") >= 4).alias("critical"), band(F.col("severity") == 3).alias("high"),
        band(F.col("severity") == 2).alias("medium"), band(F.col("severity") <= 1).alias("low"), F.countDistinct("file").alias("files"),
        F.countDistinct("kind").alias("kinds"), F.coalesce(F.max("confidence"), F.lit(0.0)).alias("top"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("mean"),
    )


def file_nodes(files: DataFrame, issues: DataFrame, arrival: str) -> DataFrame:
    """All files with their issues, severity sum, kinds and dominant kind (of the most severe issue, first by arrival)."""
    grouped = issues.where(F.col("file").isNotNull()).groupBy("file").agg(
        F.count("*").alias("issues"), F.sum("severity").alias("weight"), F.countDistinct("kind").alias("kinds"),
        F.max_by("kind", F.struct(F.col("severity"), -F.col(arrival))).alias("dominant"),
    )
    joined = files.select("file").distinct().join(grouped, "file", "left")
    return joined.select("file", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("issues", "weight", "kinds")], "dominant")


def heatmap(files: DataFrame, issues: DataFrame) -> DataFrame:
    """Risk of all files: sum of severity, and its level by the share of the highest (0.8, 0.6, 0.4, 0.2); all low if that is 0."""
    risk = issues.groupBy("file").agg(F.sum("severity").alias("risk"))
    joined = files.select("file").distinct().join(risk, "file", "left").select("file", F.coalesce("risk", F.lit(0)).alias("risk"))
    top = joined.agg(F.max("risk").alias("top"))
    share = F.when(F.col("top") > 0, F.col("risk") / F.col("top")).otherwise(0.2)
    level = F.when(share >= 0.8, "critical").when(share >= 0.6, "high").when(share >= 0.4, "medium").when(share >= 0.2, "low")
    return joined.crossJoin(top).select("file", "risk", level.otherwise("minimal").alias("level"))


def timeline(issues: DataFrame, dates: DataFrame, default: str = "2023-01-01") -> DataFrame:
    """Count and share (percent) of each kind, with the date that ``dates`` (kind, date) knows or a default."""
    counts = issues.groupBy("kind").agg(F.count("*").alias("issues"))
    total = counts.agg(F.sum("issues").alias("total"))
    share = F.round(100.0 * F.col("issues") / F.col("total"), 4)
    return counts.crossJoin(total).join(dates, "kind", "left").select(
        "kind", "issues", share.alias("percent"), F.coalesce(F.col("date").cast("string"), F.lit(default)).alias("date")
    )


def kind_clusters(issues: DataFrame) -> DataFrame:
    """Kinds with more than one issue: issues, distinct files, severity sum."""
    grouped = issues.groupBy("kind").agg(F.count("*").alias("issues"), F.countDistinct("file").alias("files"), F.sum("severity").alias("weight"))
    return grouped.where("issues > 1")


def rollup_by(issues: DataFrame, key: str) -> DataFrame:
    """Count, severity sum and mean of each value of a column."""
    return issues.groupBy(F.col(key).cast("string").alias("value")).agg(
        F.count("*").alias("issues"), F.sum("severity").alias("weight"), F.round(F.avg("severity"), 4).alias("mean")
    )


def top_files(issues: DataFrame, limit: int = 50) -> DataFrame:
    """The files with most issues: count, severity sum and mean, sorted kinds; the limit is the feature."""
    grouped = issues.where(F.col("file").isNotNull()).groupBy("file").agg(
        F.count("*").alias("issues"), F.sum("severity").alias("weight"), F.round(F.avg("severity"), 4).alias("mean"),
        F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"),
    )
    return grouped.orderBy(F.col("issues").desc(), "file").limit(limit)


def worst_with_fix(issues: DataFrame, fixes: DataFrame, arrival: str, limit: int = 1000) -> DataFrame:
    """The issues of most severity and confidence, and whether ``fixes`` has their (file, line); the limit is the feature."""
    top = issues.orderBy(F.col("severity").desc(), F.col("confidence").desc(), arrival).limit(limit)
    known = fixes.select("file", "line").distinct().withColumn("fixable", F.lit(True))
    return top.join(known, ["file", "line"], "left").withColumn("fixable", F.coalesce("fixable", F.lit(False)))


def per_severity(issues: DataFrame, arrival: str, limit: int = 20) -> DataFrame:
    """The first issues of each severity by arrival, as a text report shows them; the limit is the feature."""
    ranked = issues.withColumn("nth", F.row_number().over(Window.partitionBy("severity").orderBy(arrival)))
    return ranked.where(F.col("nth") <= limit)


def violations(rows: DataFrame, limits: Mapping[str, int], allow_tests: bool = True, fail_critical: bool = True) -> DataFrame:
    """Violations (severity, in_test, recent, critical_path) against the limits of each severity.

    Tests are exempt if allowed, and recent ones but critical. One row: a count for each severity, and ``passed``. Severity
    low never fails; any violation in a critical path does, exempt or not.
    """
    counted = (~F.col("in_test") | F.lit(not allow_tests)) & (~F.col("recent") | (F.col("severity") == "critical"))
    n = {s: F.count_if(counted & (F.col("severity") == s)) for s in ("critical", "high", "medium", "low")}
    failed = F.lit(False)
    for severity in ("critical", "high", "medium"):
        failed = failed | (n[severity] > limits[severity])
    if fail_critical:
        failed = failed | (F.count_if("critical_path") > 0)
    return rows.agg(*[c.alias(s) for s, c in n.items()], (~failed).alias("passed"))


def cluster_confidence(issues: DataFrame, cluster: str) -> DataFrame:
    """Confidence of each cluster: 0.5, plus 0.2 for one kind, 0.1 for one severity, 0.2 for one folder or 0.1 for two, 1 at most.

    The representative is the kind of the most severe issue, the least by name of equals.
    """
    folder = F.regexp_replace("file", "/[^/]*$", "")
    folders = F.countDistinct(folder)
    near = F.when(folders == 1, 0.2).when(folders == 2, 0.1).otherwise(0.0)
    total = 0.5 + F.when(F.countDistinct("kind") == 1, 0.2).otherwise(0.0) + F.when(F.countDistinct("severity") == 1, 0.1).otherwise(0.0) + near
    return issues.groupBy(cluster).agg(
        F.count("*").alias("issues"), F.min_by("kind", F.struct(-F.col("severity"), F.col("kind"))).alias("representative"),
        F.countDistinct("file", "line").alias("places"), F.round(F.least(F.lit(1.0), total), 6).alias("confidence"),
    )


def fix_impact(issues: DataFrame, effects: Mapping[str, tuple[float, float, float]]) -> DataFrame:
    """Lines removed and added and complexity taken away (1 at most) by fixing all issues, by effects of each kind, with distinct files and
    folders; the file ``<global>`` and null are none. Other kinds have no effect."""
    total = [F.lit(0.0)] * 3
    for kind, effect in effects.items():
        total = [F.when(F.col("kind") == kind, F.lit(float(e))).otherwise(t) for e, t in zip(effect, total, strict=True)]
    removed, added, less = (F.coalesce(F.sum(t), F.lit(0.0)) for t in total)
    file = F.when(F.col("file") != "<global>", F.col("file"))
    return issues.agg(
        removed.alias("removed"), added.alias("added"), (removed - added).alias("net"), F.countDistinct(file).alias("files"),
        F.countDistinct(F.regexp_replace(file, "/[^/]*$", "")).alias("folders"), F.round(F.least(F.lit(1.0), less), 6).alias("complexity"),
    )


def impact_score(severity: Column, confidence: Column, files: Column, significant: Column) -> Column:
    """min(1, confidence x severity / 5 x min(1 + 0.1 (files - 1), 2) + 0.1 if significant), to three places."""
    spread = F.least(F.lit(2.0), 1 + 0.1 * (files - 1))
    return F.round(F.least(F.lit(1.0), confidence * severity / 5.0 * spread + F.when(significant, 0.1).otherwise(0.0)), 3)


def related(issues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges (src, dst, by) from each issue to the first one that shares any of some keys: linear, and the components are those of
    all sharing pairs. Issues need ``event_id``; null keys relate nothing."""
    out = None
    for key in keys:
        own = issues.where(F.col(key).isNotNull()).select(F.col("event_id").alias("src"), F.col(key).cast("string").alias("value"))
        first = own.groupBy("value").agg(F.min("src").alias("dst"))
        found = own.join(first, "value").where("src <> dst").select("src", "dst", F.lit(key).alias("by"))
        out = found if out is None else out.unionByName(found)
    return out
