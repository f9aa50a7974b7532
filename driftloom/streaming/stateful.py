"""Stateful streams: throttled warnings, buffers of last snapshots, silent keys, keyed counters, and upserts with tombstones.

State is keyed and bounded for each key (a counter, a time, or the last few snapshots); it lives in the query's state store, which the
checkpoint location recovers after a lost executor. Rows with null keys share one key.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from driftloom.sources import versions


def throttled(stream: DataFrame, key: str, every: int = 5) -> DataFrame:
    """The 1st and then each ``every``-th occurrence of a key: key, nth. A key's state is one number."""

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        out = []
        for frame in frames:
            out += [n for n in range(seen + 1, seen + len(frame) + 1) if n == 1 or n % every == 0]
            seen += len(frame)
        state.update((seen,))
        yield pd.DataFrame({"key": [keys[0]] * len(out), "nth": out})

    keyed = stream.select(F.col(key).cast("string").alias("key"))
    return keyed.groupBy("key").applyInPandasWithState(step, "key string, nth long", "seen long", "append", GroupStateTimeout.NoTimeout)


def buffered(stream: DataFrame, key: str, time: str, value: str, keep: int = 10) -> DataFrame:
    """Each snapshot with its distance from the key's snapshot before it: key, at, value, moved. The state holds the last ``keep`` snapshots."""

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        fresh = sorted((r.at, r.value) for frame in frames for r in frame.itertuples())
        out = []
        for at, v in fresh:
            out.append((keys[0], at, v, abs(v - held[-1][1]) if held else None))
            held = [*held, (at, v)][-keep:]
        state.update(([a for a, _ in held], [v for _, v in held]))
        yield pd.DataFrame(out, columns=["key", "at", "value", "moved"])

    keyed = stream.select(F.col(key).cast("string").alias("key"), F.unix_micros(time).alias("at"), F.col(value).cast("double").alias("value"))
    return keyed.groupBy("key").applyInPandasWithState(step, "key string, at long, value double, moved double", "ats array<long>, vs array<double>", "append", GroupStateTimeout.NoTimeout)


def silent(stream: DataFrame, key: str, time: str, limit: str, lateness: str) -> DataFrame:
    """Keys without a sign of life for ``limit`` of event time: key, last (microseconds). State ends with the alarm."""
    seconds = stream.sparkSession.sql(f"select timestampdiff(SECOND, timestamp'1970-01-01', timestamp'1970-01-01' + interval {limit})").first()[0]

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"key": [keys[0]], "last": [last]})
            return
        last = max([state.get[0]] if state.exists else [0])
        for frame in frames:
            last = max(last, int(frame["at"].max()))
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    keyed = stream.withWatermark(time, lateness).select(F.col(key).cast("string").alias("key"), F.col(time).alias("time"), F.unix_micros(time).alias("at"))
    return keyed.groupBy("key").applyInPandasWithState(step, "key string, last long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def counters(stream: DataFrame, key: str, success: str) -> DataFrame:
    """Running tries, successes and failures of each key (update mode)."""
    ok = F.col(success).cast("boolean")
    return stream.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("tries"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"))


def upserted(spark: SparkSession, folder: str, key: str, version: str, deleted: str, buckets: int = 64):
    """A ``foreachBatch`` writer that keeps the newest row of each key in a dataset; ``current`` reads it.

    Keys are dealt into ``buckets``; a batch rewrites those that it touches, and its version of the dataset (``sources.versions``) names the
    files of every bucket, so a batch that is tried again, or fails half-way, changes nothing that readers see. Newest rows that are
    marked deleted stay as tombstones, so an older row that comes late brings nothing back. Of rows of one version a
    deleted one counts, then the one with the largest hash. A null mark is not deleted; rows without key stay out.
    """

    def write(batch: DataFrame, number: int) -> None:
        columns = batch.columns
        own = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        rows = batch.where(F.col(key).isNotNull()).withColumn(deleted, F.coalesce(deleted, F.lit(False))).withColumn("_bucket", own)
        done = versions.numbers(spark, folder)
        before = versions.read(spark, folder, done[-1]) if done else {"batch": -1, "buckets": {}}
        touched = sorted(r[0] for r in rows.select("_bucket").distinct().collect())  # at most ``buckets`` numbers
        if number <= before["batch"] or not touched:
            return
        old = [before["buckets"][str(b)] for b in touched if str(b) in before["buckets"]]
        if old:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(*[f"{folder}/{at}" for at in old]).withColumn("_bucket", own))
        order = F.struct(F.col(version), F.col(deleted).cast("int"), F.xxhash64(*columns))
        newest = rows.groupBy("_bucket", key).agg(F.max_by(F.struct(*columns), order).alias("r")).select("_bucket", "r.*")
        name = f"batch-{number}-{uuid.uuid4().hex}"
        newest.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{folder}/{name}")
        named = before["buckets"] | {str(b): f"{name}/_bucket={b}" for b in touched}
        versions.commit(spark, folder, done[-1] + 1 if done else 0, {"batch": number, "buckets": named, "schema": batch.schema.json()})

    return write


def current(spark: SparkSession, folder: str, deleted: str) -> DataFrame:
    """The rows of an ``upserted`` dataset that are not deleted."""
    says = versions.read(spark, folder, versions.numbers(spark, folder)[-1])
    schema = StructType.fromJson(json.loads(says["schema"]))
    return spark.read.schema(schema).parquet(*[f"{folder}/{at}" for at in sorted(says["buckets"].values())]).where(~F.col(deleted))


def run_once(stream: DataFrame, write, checkpoint: str) -> None:
    """Feeds all that is there to a batch writer and stops; the checkpoint remembers how far it came, so the next run resumes."""
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write).start().awaitTermination()
