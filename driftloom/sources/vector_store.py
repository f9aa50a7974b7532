"""A stored vector index: append-only batches, rows by key and rows by cell, commits that readers trust.

A folder holds ``centres`` (the cells' centres and the index's parameters), ``rows/batch=/part=`` (keys, vectors and other columns,
dealt by key), ``cells/batch=/cell=`` (keys and vectors, dealt by nearest centre) and ``commits`` (one small file for each batch).

* ``append`` writes a batch beside the others and then commits it; no stored file is touched, and a batch that failed before its
  commit is invisible. A batch named like a committed one is not written again, so a retried job appends once.
* ``lookup`` reads the parts of the asked keys only; ``nearest`` meets each query with the members of its nearest cells, in blocks, so no
  cell gathers in a task however full it is; every row is in a cell.
* Centres are fitted on at most ``SAMPLE`` rows taken by a hash over all, and so is the number of cells to probe: the least that reaches
  the wanted recall between sampled rows. Vectors without structure need about half the cells; clustered ones a few.

Rules: keys are whole numbers; rows without key or vector stay out; of rows with one key in a batch the one with the least hash counts,
and a key that is stored already keeps its row. An empty table makes a store with one cell; a batch
without new rows isn't committed. One writer at a time: a second
one that commits under the same number fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.operators.vectors import _matrix, _table, _unit

#: Rows that centres and probes are fitted on, and rounds of the fit.
SAMPLE, ROUNDS = 20_000, 12
#: Sampled rows whose neighbours calibrate the probes.
ASKED = 400
#: Centres that an index has at most; they are sent to each task.
MOST_CELLS = 16_384
#: Rows of one side of a block.
BLOCK = 4096
#: Parts that rows are dealt into by key.
PARTS = 64


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres by spherical k-means."""
    if not len(sample):
        return np.zeros((1, 0))
    rows, rng = _unit(sample), np.random.default_rng(7)
    centres = rows[rng.choice(len(rows), min(cells, len(rows)), replace=False)]
    for _ in range(ROUNDS):
        own = np.argmax(rows @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        held = np.bincount(own, minlength=len(centres)) > 0
        centres = np.where(held[:, None], _unit(sums), centres)
    return centres


def _probes(sample: np.ndarray, centres: np.ndarray, recall: float, k: int = 10) -> int:
    """The least number of nearest cells that hold the wanted share of the sampled rows' neighbours."""
    if len(sample) <= k:
        return len(centres)
    rows = _unit(sample)
    asked = np.arange(0, len(rows), max(1, len(rows) // ASKED))
    near = rows[asked] @ rows.T
    near[np.arange(len(asked)), asked] = -2
    best = np.argsort(-near, axis=1)[:, :k]
    cell = np.argmax(rows @ centres.T, axis=1)
    rank = np.argsort(np.argsort(-(rows[asked] @ centres.T), axis=1), axis=1)
    place = np.sort(rank[np.arange(len(asked))[:, None], cell[best]].ravel())
    return int(place[min(len(place) - 1, int(np.ceil(recall * len(place))))]) + 1


def create(rows: DataFrame, folder: str, key: str, vector: str, cells: int | None = None, recall: float = 0.95) -> None:
    """Starts a store whose cells suit ``rows``, which are not stored by this. ``cells``: square root of the rows if not given."""
    spark = rows.sparkSession
    known = rows.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v")).where("k is not null and v is not null")
    n = known.count()
    wanted = min(MOST_CELLS, cells or max(1, int(n**0.5)))
    taken = known.where(F.pmod(F.xxhash64("k"), F.lit(1_000_000)) < min(1_000_000, -(-SAMPLE * 900_000 // max(n, 1)))).limit(SAMPLE).toArrow()
    sample = _matrix(taken)
    centres = _fit(sample, wanted)
    probes = _probes(sample, centres, recall)
    found = [(i, c.tolist(), probes, PARTS) for i, c in enumerate(centres)]
    spark.createDataFrame(found, "cell int, centre array<double>, probes int, parts int").coalesce(1).write.parquet(f"{folder}/centres")


def _centres(spark: SparkSession, folder: str) -> tuple[np.ndarray, int, int]:
    found = spark.read.parquet(f"{folder}/centres").orderBy("cell").collect()
    return np.array([r.centre for r in found]), found[0].probes, found[0].parts


def committed(spark: SparkSession, folder: str) -> list[str]:
    """The batches that readers see, in order."""
    files, path = _files(spark, folder)
    at = path(f"{folder}/commits")
    if not files.exists(at):
        return []
    return [name.split("-", 1)[1] for name in sorted(s.getPath().getName() for s in files.listStatus(at)) if "-" in name]


def _stored(spark: SparkSession, folder: str, kind: str) -> DataFrame | None:
    batches = committed(spark, folder)
    if not batches:
        return None
    return spark.read.option("basePath", f"{folder}/{kind}").option("mergeSchema", "true").parquet(*[f"{folder}/{kind}/batch={b}" for b in batches]).drop("batch")


def _nearest_cells(rows: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """Rows (k, v) with their ``probes`` nearest cells, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _unit(_matrix(pa.Table.from_batches([batch]))) @ centres.T if centres.shape[1] else np.zeros((batch.num_rows, 1))
                best = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                at = pa.array(np.repeat(np.arange(batch.num_rows), best.shape[1]))
                yield pa.RecordBatch.from_arrays([batch["k"].take(at), batch["v"].take(at), pa.array(best.ravel().astype(np.int32))], names=["k", "v", "cell"])

    return rows.mapInArrow(run, "k long, v array<double>, cell int")


def append(rows: DataFrame, folder: str, key: str, vector: str, batch: str | None = None) -> str:
    """Stores the rows whose keys are new, with all their columns, and returns the batch's name."""
    spark, name = rows.sparkSession, batch or uuid.uuid4().hex
    before = committed(spark, folder)
    if name in before:
        return name
    centres, _, parts = _centres(spark, folder)
    own = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    fresh = rows.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"), own.alias("row")).where("k is not null and v is not null")
    fresh = fresh.withColumn("part", F.pmod("k", F.lit(parts)).cast("int"))
    there = _stored(spark, folder, "rows")
    if there is not None:
        fresh = fresh.join(there.select("part", "k"), ["part", "k"], "left_anti")
    fresh = fresh.groupBy("part", "k").agg(F.min_by(F.struct("v", "row"), F.xxhash64("row")).alias("x")).select("k", "x.v", "x.row", "part")
    at = f"batch={name}"
    fresh.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/rows/{at}")
    written = spark.read.schema("k long, v array<double>").parquet(f"{folder}/rows/{at}")
    if written.isEmpty():
        return name
    _nearest_cells(written, centres, 1).repartition("cell", F.pmod(F.xxhash64("k"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/cells/{at}")
    files, path = _files(spark, folder)
    files.create(path(f"{folder}/commits/{len(before):09d}-{name}"), False).close()
    later = committed(spark, folder)
    if later[len(before)] != name:
        raise RuntimeError("another writer committed meanwhile; append again under another name")
    return name


def vectors(spark: SparkSession, folder: str) -> DataFrame | None:
    """All stored rows as they were given; null for a store without batches."""
    stored = _stored(spark, folder, "rows")
    return None if stored is None else stored.select("row.*")


def lookup(spark: SparkSession, folder: str, keys: list[int]) -> DataFrame | None:
    """The rows of some keys; only their parts are read."""
    stored = _stored(spark, folder, "rows")
    if stored is None:
        return None
    parts = _centres(spark, folder)[2]
    return stored.where(F.col("part").isin(sorted({k % parts for k in keys})) & F.col("k").isin(keys)).select("row.*")


def merge(spark: SparkSession, folder: str, other: str, key: str, vector: str) -> str | None:
    """Appends the rows of another store whose keys are new here."""
    rows = vectors(spark, other)
    return None if rows is None else append(rows, folder, key, vector)


def nearest(spark: SparkSession, folder: str, queries: DataFrame, key: str, vector: str, k: int = 10, probes: int | None = None) -> DataFrame:
    """The ``k`` most similar stored rows of each query, itself apart: a, b, similarity, nth. Ties go to the smaller key.

    A query meets the members of its ``probes`` nearest cells (those that the fit found to reach its recall, if not given). Cells
    larger than a block are cut on both sides; a block gives out each query's best ``k`` only.
    """
    centres, fitted, _ = _centres(spark, folder)
    asked = queries.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).where("k is not null and v is not null")
    members = _stored(spark, folder, "cells")
    if members is None:
        return spark.createDataFrame([], "a long, b long, similarity double, nth int")
    # a repeated key asks once, by the rule of append
    asked = asked.groupBy("k").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    asked = _nearest_cells(asked, centres, probes or fitted)
    blocks = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias(name))
    # a row for each cell, of which there are at most MOST_CELLS
    sizes = F.broadcast(blocks(asked, "down").join(blocks(members, "across"), "cell"))
    own = lambda n: F.pmod(F.xxhash64("k"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = asked.join(sizes, "cell").select("cell", own("down").alias("i"), every("across").alias("j"), "k", "v")
    columns = members.join(sizes, "cell").select("cell", every("down").alias("i"), own("across").alias("j"), "k", "v")
    schema = "a long, b long, similarity double"

    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table(schema, [[], [], []])
        a, b = left["k"].to_numpy(), right["k"].to_numpy()
        near = np.round(_unit(_matrix(left)) @ _unit(_matrix(right)).T, 6)
        out = [[], [], []]
        for at, row in zip(a, near, strict=True):
            some = np.flatnonzero(b != at)
            best = some[np.lexsort((b[some], -row[some]))[:k]]
            for column, value in zip(out, (np.full(len(best), at), b[best], row[best]), strict=True):
                column.append(value)
        return _table(schema, [np.concatenate(c) for c in out])

    block = ["cell", "i", "j"]
    scored = rows.groupBy(*block).cogroup(columns.groupBy(*block)).applyInArrow(step, schema)
    order = Window.partitionBy("a").orderBy(F.col("similarity").desc(), "b")
    return scored.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
