"""The stored vector index: round trips, pruned lookups, merges, retries, and recall by brute force."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.operators import vectors
from driftloom.sources import vector_store as vs
from driftloom.sources.tables import table

SF = "/root/testdata/sf0.01"


@pytest.fixture
def store(spark, tmp_path):
    rows = table(spark, SF, "embeddings")
    folder = f"{tmp_path}/store"
    vs.create(rows, folder, "vec_id", "embedding")
    return folder


def _clustered(spark, n=3000):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    rows = [(i, (centres[i % 40] + 0.3 * rng.normal(size=32)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, v array<double>")


def _files(folder):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/**/*.parquet", recursive=True)}


def test_rows_come_back_and_appends_touch_nothing(spark, store):
    rows = table(spark, SF, "embeddings")
    vs.append(rows.where("vec_id % 2 = 0"), store, "vec_id", "embedding", "even")
    held = _files(store)
    vs.append(rows, store, "vec_id", "embedding", "all")  # half of it is there
    now = _files(store)
    assert held.items() <= now.items() and len(now) > len(held)
    back = vs.vectors(spark, store)
    assert back.columns == rows.columns
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    vs.append(rows, store, "vec_id", "embedding", "all")
    assert vs.committed(spark, store) == ["even", "all"] and _files(store) == now


def test_lookup_reads_one_part(spark, store):
    rows = table(spark, SF, "embeddings")
    vs.append(rows, store, "vec_id", "embedding")
    found = vs.lookup(spark, store, [77])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "(part#" in plan and "= 13)" in plan
    assert [r.vec_id for r in found.collect()] == [77]
    assert vs.lookup(spark, store, [10**9]).count() == 0


def test_merge_keeps_what_is_there(spark, store, tmp_path):
    rows, other = table(spark, SF, "embeddings"), f"{tmp_path}/shard"
    vs.append(rows.where("vec_id < 300"), store, "vec_id", "embedding")
    vs.create(rows, other, "vec_id", "embedding", cells=4)
    vs.append(rows.where("vec_id >= 200").withColumn("label", F.lit(-1)), other, "vec_id", "embedding")
    vs.merge(spark, store, other, "vec_id", "embedding")
    got = vs.vectors(spark, store)
    assert got.count() == rows.count() and got.where("label = -1").count() == rows.where("vec_id >= 300").count()


def test_a_batch_without_commit_is_invisible(spark, store):
    rows = table(spark, SF, "embeddings")
    vs.append(rows.where("vec_id < 100"), store, "vec_id", "embedding", "one")
    files, path = vs._files(spark, store)
    files.mkdirs(path(f"{store}/rows/batch=lost/part=1"))
    assert vs.vectors(spark, store).count() == rows.where("vec_id < 100").count()


@pytest.mark.parametrize("clustered", [True, False])
def test_recall_against_brute_force(spark, tmp_path, monkeypatch, clustered):
    monkeypatch.setattr(vs, "BLOCK", 50)  # cells are cut
    rows, key, vector = (_clustered(spark), "id", "v") if clustered else (table(spark, SF, "embeddings"), "vec_id", "embedding")
    folder = f"{tmp_path}/store"
    vs.create(rows, folder, key, vector)
    vs.append(rows.where(f"{key} % 3 = 0"), folder, key, vector)
    vs.append(rows.where(f"{key} % 3 <> 0"), folder, key, vector)
    asked = rows.where(f"{key} % 50 = 0")
    found = vs.nearest(spark, folder, asked, key, vector, 10).collect()
    assert max(r.nth for r in found) == 10
    exact = {(r.a, r.b): r.similarity for r in vectors.top_k(asked, rows, key, vector, 10).collect()}
    hits = [r for r in found if (r.a, r.b) in exact]
    assert len(hits) >= 0.9 * len(exact) and all(abs(r.similarity - exact[r.a, r.b]) < 1e-5 for r in hits)
    if clustered:
        assert vs._centres(spark, folder)[1] <= len(vs._centres(spark, folder)[0]) // 5
    every = vs.nearest(spark, folder, asked, key, vector, 10, probes=len(vs._centres(spark, folder)[0])).collect()
    assert {(r.a, r.b) for r in every} == set(exact)


def test_nulls_repeats_and_empty_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (None, [0.0, 1.0], "y"), (3, None, "z"), (4, [0.0, 0.0], "zero")], "id long, v array<double>, k string")
    folder = f"{tmp_path}/store"
    vs.create(rows.where("1 = 0"), folder, "id", "v")
    assert vs.vectors(spark, folder) is None and vs.lookup(spark, folder, [1]) is None
    assert vs.nearest(spark, folder, rows, "id", "v").collect() == []
    vs.append(rows.where("1 = 0"), folder, "id", "v")
    vs.append(rows, folder, "id", "v")
    assert sorted(r.id for r in vs.vectors(spark, folder).collect()) == [1, 4]
    assert [(r.a, r.b) for r in vs.nearest(spark, folder, rows, "id", "v", 3).collect()] == [(1, 4), (4, 1)]
