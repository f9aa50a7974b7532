"""Bundles of shifted token vectors against their definition as rows of places."""

import pytest
from pyspark.sql import functions as F

from driftloom.operators import hypervectors as hv

ROWS = [(1, ["a", "b", "a", "é ü"]), (2, []), (3, None), (4, ["a"]), (5, [None, "x", ""]), (6, [f"t{k % 7}" for k in range(90)]), (7, ["a", "b"]), (7, ["c"]), (None, ["a", "c"])]


@pytest.mark.parametrize("size", [1, 16, 64])
def test_equals_the_bundle_of_places(spark, size):
    frame = spark.createDataFrame(ROWS, "key long, t array<string>").repartition(3)
    steps = frame.select("key", F.posexplode("t").alias("at", "token"))
    want = hv.bundle(steps.select("key", hv.permute(hv.token_vector(F.col("token"), size), F.col("at")).alias("v")), "key", F.col("v"))
    got = hv.sequence_vectors(frame, "key", F.col("t"), size)
    assert {r.key: r.vector for r in got.collect()} == {r.key: r.vector for r in want.collect()}
    assert got.dtypes == want.dtypes and got.count() == 6


def test_token_vectors():
    bits = hv._token_bits([b"a", None, b"\xc3\xa9"], 8)
    assert bits.shape == (3, 8) and (bits[1] == -1).all() and set(bits.ravel().tolist()) == {1, -1}
    assert hv._token_bits([], 8).shape == (0, 8)


def test_long_rows(spark):
    tokens = [f"t{k % 5}" for k in range(hv.TOKENS + 7)]
    frame = spark.createDataFrame([(1, tokens), (2, tokens[:3])], "key long, t array<string>").coalesce(1)
    got = {r.key: r.vector for r in hv.sequence_vectors(frame, "key", F.col("t"), 8).collect()}
    bits = dict(zip([f"t{k}" for k in range(5)], hv._token_bits([b"t%d" % k for k in range(5)], 8).tolist(), strict=True))
    for key, some in ((1, tokens), (2, tokens[:3])):
        total = [sum(bits[t][(i - at) % 8] for at, t in enumerate(some)) for i in range(8)]
        assert got[key] == [(x > 0) - (x < 0) for x in total]


def test_places_are_no_rows(spark):
    frame = spark.createDataFrame(ROWS, "key long, t array<string>")
    plan = hv.sequence_vectors(frame, "key", F.col("t"), 64)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "Repartition" in plan
