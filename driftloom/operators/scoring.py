"""Weighted risk scores, distributions, trends and comparisons of issue rows.

Issues have kind, severity, confidence, file, line and symbol. Weights are a small mapping in the session; unknown kinds
weigh 1. Null files score under ``<global>``. Keys compare nulls as equal.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Issue identity: two rows with these equal (nulls too) are one issue.
IDENTITY = ("kind", "file", "line", "symbol")


def _weight(weights: Mapping[str, float]) -> Column:
    found = F.lit(1.0)
    for kind, weight in weights.items():
        found = F.when(F.col("kind") == kind, F.lit(float(weight))).otherwise(found)
    return found


def module_scores(issues: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Sum of weight x severity x confidence for each file: module, score, issues."""
    worth = _weight(weights) * F.col("severity") * F.col("confidence")
    scored = issues.groupBy(F.coalesce("file", F.lit("<global>")).alias("module"))
    return scored.agg(F.round(F.sum(worth), 2).alias("score"), F.count("*").alias("issues"))


def risk_level(score: Column, critical: float = 30.0, warning: float = 15.0) -> Column:
    """CRITICAL, WARNING or OK."""
    return F.when(score >= critical, "CRITICAL").when(score >= warning, "WARNING").otherwise("OK")


def global_score(scores: DataFrame) -> DataFrame:
    """Mean module score, raised with the number of modules up to twofold; 0 without modules."""
    size = F.least(F.count("*") / F.lit(10.0), F.lit(2.0))
    return scores.agg(F.round(F.coalesce(F.avg("score") * size, F.lit(0.0)), 2).alias("global_score"))


def distribution(issues: DataFrame) -> DataFrame:
    """Number of issues of each kind."""
    return issues.groupBy("kind").agg(F.count("*").alias("issues"))


def severity_bands(issues: DataFrame) -> DataFrame:
    """Issues by band: 4 and up critical, 3 high, 2 medium, below low."""
    band = F.when(F.col("severity") >= 4, "critical").when(F.col("severity") == 3, "high").when(F.col("severity") == 2, "medium")
    return issues.groupBy(band.otherwise("low").alias("band")).agg(F.count("*").alias("issues"))


def top_modules(scores: DataFrame, limit: int = 10) -> DataFrame:
    """The highest scores; the limit is the feature."""
    return scores.orderBy(F.col("score").desc(), "module").limit(limit)


def deduplicate(issues: DataFrame, arrival: str) -> DataFrame:
    """The first row by arrival of each identity."""
    first = Window.partitionBy(*IDENTITY).orderBy(arrival)
    return issues.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def group_by_file(issues: DataFrame) -> DataFrame:
    """Issues, worst severity and kinds of each file; null files as ``<no-file>``."""
    grouped = issues.groupBy(F.coalesce("file", F.lit("<no-file>")).alias("file"))
    return grouped.agg(
        F.count("*").alias("issues"), F.max("severity").alias("worst"), F.countDistinct("kind").alias("kinds")
    )


def classify(base: DataFrame, current: DataFrame) -> DataFrame:
    """Full outer comparison of two runs by identity: status new, fixed or existing, and how many identities have it."""
    keys = [F.col(c) for c in IDENTITY]
    tagged = base.select(*keys, F.lit(1).alias("b"), F.lit(0).alias("c")).unionByName(
        current.select(*keys, F.lit(0).alias("b"), F.lit(1).alias("c"))
    )
    sides = tagged.groupBy(*IDENTITY).agg(F.max("b").alias("b"), F.max("c").alias("c"))
    status = F.when(F.col("b") == 0, "new").when(F.col("c") == 0, "fixed").otherwise("existing")
    return sides.groupBy(status.alias("status")).agg(F.count("*").alias("identities"))


def trend(base: DataFrame, current: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Change of the total score between two runs; no change counts as worsening."""
    worth = F.round(F.sum(_weight(weights) * F.col("severity") * F.col("confidence")), 2)
    both = base.agg(F.coalesce(worth, F.lit(0.0)).alias("before")).crossJoin(current.agg(F.coalesce(worth, F.lit(0.0)).alias("after")))
    change = F.round(F.col("after") - F.col("before"), 2)
    percent = F.when(F.col("before") == 0, 0.0).otherwise(F.round(100 * change / F.col("before"), 2))
    return both.select(
        "before", "after", change.alias("change"), percent.alias("percent"),
        F.when(change < 0, "improving").otherwise("worsening").alias("direction"),
    )
