"""How the supplied tables stand in for issues, edges, baskets, histories and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.sources.tables import table

WEIGHTS = {"error": 3.0, "purchase": 2.0, "signup": 1.0, "click": 0.5}
SPLIT = "2024-01-16"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(
        "event_id", "ts", F.col("event_type").alias("kind"), (1 + F.col("event_id") % 5).cast("int").alias("severity"),
        ((1 + F.col("event_id") % 4) / 4.0).alias("confidence"),
        F.when(F.col("user_id") % 11 != 0, F.concat(F.lit("m"), (F.col("user_id") % 40).cast("string"))).alias("file"),
        (F.col("event_id") % 50).cast("int").alias("line"),
        F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("s"), (F.col("user_id") % 25).cast("string"))).alias("symbol"),
    )


def runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Issues before and since the middle of the history."""
    all_rows, middle = issues(spark, sf_dir), F.lit(SPLIT).cast("timestamp_ntz")
    return all_rows.where(F.col("ts") < middle), all_rows.where(F.col("ts") >= middle)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph over identifiers: supplier to part."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_suppkey").alias("item"))


#: The same in SQL, as common table expressions.
ISSUES = """issues as (select event_id, ts, event_type as kind, (1 + event_id % 5)::int as severity, (1 + event_id % 4) / 4.0::double as confidence,
  case when user_id % 11 <> 0 then 'm' || (user_id % 40) end as file, (event_id % 50)::int as line,
  case when event_id % 7 <> 0 then 's' || (user_id % 25) end as symbol from events)"""
WEIGHT = "case kind when 'error' then 3.0::double when 'purchase' then 2.0 when 'signup' then 1.0 when 'click' then 0.5 else 1.0 end"
EDGES = "edges as (select l_suppkey as src, l_partkey as dst from lineitem)"
BASKETS = "baskets as (select distinct l_orderkey as basket, l_suppkey as item from lineitem)"
