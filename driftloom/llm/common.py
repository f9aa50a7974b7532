"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as used by every word definition here.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once per row and hands it to ``body`` as a variable.

    A lambda that refers to an outer expression evaluates it for each element; binding it through a one-element
    array keeps such work linear.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the maximal runs of other than ASCII white space; null text gives an empty array."""
    return F.array_remove(F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)), r"[\x20\x09-\x0D]+"), "")


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.size(words(text)).cast("long")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the frame does not have, so added columns never clash."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name = "_" + name
    return name


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the cluster's ``spark.checkpoint.dir``; a temporary folder only in local mode with none set (tests)."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    import uuid

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def drop_dir(spark: SparkSession, path: str) -> None:
    """Removes a folder that this package wrote and nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage into the shared folder, so a lost executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parts(spark: SparkSession, units: int, per_part: int, least: int = 12) -> int:
    """Number of partitions that keeps each near ``per_part`` units, however large the input."""
    return max(least, -(-units // per_part))


def below(ordered: Column, value: Column) -> Column:
    """Number of items of an ascending array that are less than ``value``, by bisection."""

    def search(items: Column) -> Column:
        def step(acc: Column, _: Column) -> Column:
            mid = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
            less = F.get(items, mid) < value
            return F.when(acc["low"] >= acc["high"], acc).otherwise(
                F.struct(F.when(less, mid + 1).otherwise(acc["low"]).alias("low"), F.when(less, acc["high"]).otherwise(mid).alias("high"))
            )

        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(items) + F.lit(1))).cast("int"))
        start = F.struct(F.lit(0).alias("low"), F.size(items).alias("high"))
        return F.aggregate(rounds, start, step, lambda acc: acc["low"])

    return let(ordered, search)
