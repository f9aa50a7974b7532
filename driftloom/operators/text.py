"""Token statistics, TF-IDF, entropy and pattern rules over texts."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions.columns import tokens


def term_counts(rows: DataFrame, key: str, text: str, split: Callable[[Column], Column] = tokens) -> DataFrame:
    """(key, term, tf) rows."""
    exploded = rows.select(F.col(key), F.explode(split(F.coalesce(F.col(text), F.lit("")))).alias("term"))
    return exploded.groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_frequency(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("uses"))


def tfidf_top(terms: DataFrame, total: int, key: str, k: int) -> DataFrame:
    """The ``k`` heaviest terms of each text by tf x (ln((1 + N) / (1 + df)) + 1)."""
    idf = F.log((1.0 + total) / (1.0 + F.col("df"))) + 1
    weighed = terms.join(document_frequency(terms).select("term", "df"), "term").withColumn("weight", F.round(F.col("tf") * idf, 4))
    order = Window.partitionBy(key).orderBy(F.col("weight").desc(), "term")
    return weighed.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).select(key, "term", "tf", "weight", "nth")


def entropy(terms: DataFrame, key: str) -> DataFrame:
    """Shannon entropy of each text's words in bits, and the share of different words."""
    whole = F.sum("tf").over(Window.partitionBy(key))
    shares = terms.withColumns({"_all": whole, "_p": F.col("tf") / whole})
    return shares.groupBy(key).agg(
        F.round(-F.sum(F.col("_p") * F.log2("_p")), 4).alias("entropy"), F.max("_all").alias("words"),
        F.round(F.count("*") / F.max("_all"), 4).alias("variety"),
    )


def pattern_hits(rows: DataFrame, key: str, text: str, rules: Mapping[str, str]) -> DataFrame:
    """Matches of each named pattern in each text that has any: key, rule, hits."""
    counts = F.array(*[F.struct(F.lit(n).alias("rule"), F.regexp_count(F.col(text), F.lit(p)).alias("hits")) for n, p in rules.items()])
    return rows.select(F.col(key), F.explode(counts).alias("c")).select(key, "c.rule", "c.hits").where("hits > 0")
