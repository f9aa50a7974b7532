"""Table access by folder: one parquet dataset per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazily opens ``<sf_dir>/<name>.parquet``; any scheme Spark's readers know works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Registers the tables as temporary views for SQL callers."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
