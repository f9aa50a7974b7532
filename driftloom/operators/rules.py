"""Row rules, rankings, quotas and empirical significance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import numbered

from .vectors import group_counts


def normalized_messages(rows: DataFrame, message: str) -> DataFrame:
    """Messages with digits as N and quoted text emptied, and how often each form occurs: form, rows."""
    form = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(message), F.lit("")), "[0-9]+", "N"), '"[^"]*"', '""')
    return rows.groupBy(form.alias("form")).agg(F.count("*").alias("rows"))


def character_entropy(rows: DataFrame, name: str) -> DataFrame:
    """Shannon entropy of the characters of each distinct name, in bits."""
    letters = rows.select(F.col(name).alias("name")).distinct().select("name", F.explode(F.regexp_extract_all("name", F.lit("(?s)."), F.lit(0))).alias("c"))
    counted = letters.groupBy("name", "c").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("name"))
    return counted.withColumn("p", share).groupBy("name").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 4).alias("entropy"))


def frequent_tokens(rows: DataFrame, name: str, least: float) -> DataFrame:
    """Words that at least that share of the distinct names hold: token, names."""
    names = rows.select(F.col(name).alias("name")).distinct()
    total = names.agg(F.count("*").alias("total"))
    held = names.select("name", F.explode(F.array_distinct(F.split("name", " "))).alias("token")).groupBy("token").agg(F.count("*").alias("names"))
    return held.join(F.broadcast(total)).where(F.col("names") >= least * F.col("total")).select("token", "names")


def progressions(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Whether each key's values, of at least two, are an arithmetic progression: key, n, perfect."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_s", step).groupBy(key).agg(
        F.count("*").alias("n"), (F.min("_s") == F.max("_s")).alias("perfect")
    ).where("n >= 2")


def contact(distance: Column, alpha: float = 1.2, kappa: float = 1.0, epsilon: float = 1e-6) -> Column:
    """Contact probability at a distance: at most 1."""
    return F.least(F.lit(1.0), F.lit(kappa) * F.pow(distance + epsilon, F.lit(-alpha)))


def quota_sample(rows: DataFrame, stratum: str, key: str, percent: int) -> DataFrame:
    """A stated share of each stratum, at least one row, chosen by a hash of the key; the sample is the feature."""
    placed = numbered(rows.select(stratum, key), [F.md5(F.col(key).cast("string")), key], [stratum], "_n")
    sizes = rows.groupBy(F.col(stratum).alias("_s")).agg(F.greatest(F.lit(1), F.floor(F.count("*") * percent / 100)).alias("_most"))
    kept = placed.join(sizes, F.col(stratum).eqNullSafe(F.col("_s")))
    return kept.where(F.col("_n") <= F.col("_most")).select(stratum, key)


def significance(pairs: DataFrame) -> DataFrame:
    """Empirical p of each distance: the share of all distances at most as large: a, b, p."""
    tallied = pairs.groupBy("distance").agg(F.count("*").alias("n"))
    # distinct distances are few: at most one for each number of unequal places
    upto = Window.orderBy("distance").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = tallied.select("distance", F.round(F.sum("n").over(upto) / F.sum("n").over(Window.partitionBy(F.lit(0))), 6).alias("p"))
    # broadcast, as few keys would send most pairs to few tasks
    return pairs.join(F.broadcast(share), "distance").select("a", "b", "p")


def cross_group_pairs(rows: DataFrame, key: str, vector: str, group: str, least: float) -> DataFrame:
    """Similar pairs between different groups: low, high, pairs, severity by the number of pairs."""
    counted = group_counts(rows, key, vector, group, least)
    severity = F.when(F.col("pairs") > 10, 4).when(F.col("pairs") > 5, 3).when(F.col("pairs") > 2, 2).otherwise(1)
    return counted.withColumn("severity", severity)


def recent_average(events: DataFrame, key: str, ts: str, value: str, tie: str, width: int = 10) -> DataFrame:
    """Mean of the last ``width`` values up to each row, in hundredths: tie, mean."""
    back = Window.partitionBy(key).orderBy(ts, tie).rowsBetween(-(width - 1), Window.currentRow)
    cents = F.round(100 * F.col(value)).cast("bigint")
    return events.select(tie, F.round(F.avg(cents).over(back), 4).alias("mean"))


def unmatched(references: DataFrame, definitions: DataFrame, name: str) -> DataFrame:
    """References to undefined names, by name: name, uses."""
    return references.join(definitions.select(name).distinct(), name, "left_anti").groupBy(name).agg(F.count("*").alias("uses"))
