"""Structured Streaming forms of the event-history operators.

Each function takes a streaming (or batch) frame of events and returns one; sinks and triggers are the caller's. Watermarks bound
the state, so late rows beyond them are dropped by design of the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read(spark, folder: str, schema) -> DataFrame:
    """A stream over the parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed_counts(events: DataFrame, ts: str, label: str, width: str, late: str) -> DataFrame:
    """Events of each label in tumbling windows: start, label, events."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    counted = timed.groupBy(F.window("_ts", width), label).agg(F.count("*").alias("events"))
    return counted.select(F.col("window.start").alias("start"), label, "events")


def session_chains(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Sessions of a key with gaps up to ``gap``: key, start, end, events."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    counted = timed.groupBy(F.session_window("_ts", gap), key).agg(F.count("*").alias("events"))
    return counted.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def first_seen(events: DataFrame, identity: list[str], ts: str, late: str) -> DataFrame:
    """The first row of each identity within the watermark; later ones are duplicates."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.dropDuplicatesWithinWatermark(identity).drop("_ts")
