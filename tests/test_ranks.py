"""Row numbers over whole tables and groups, by plain Python."""

import random

from pyspark.sql import functions as F

from driftloom.operators import histories
from driftloom.operators.ranks import numbered


def _rows():
    rng = random.Random(1)
    return [(i, None if i % 11 == 0 else rng.choice("aaaaab"), rng.randint(0, 50)) for i in range(1000)]


def test_numbers_are_those_of_one_sort(spark):
    frame = spark.createDataFrame(_rows(), "id long, g string, v int").repartition(7)
    whole = sorted(_rows(), key=lambda r: (-r[2], r[0]))
    got = {r.id: r.nth for r in numbered(frame, [F.col("v").desc(), "id"]).collect()}
    assert got == {r[0]: k + 1 for k, r in enumerate(whole)}
    got = {r.id: r.place for r in numbered(frame, [F.col("v").desc(), "id"], ["g"], "place").collect()}
    want = {}
    for g in {r[1] for r in whole}:
        want |= {r[0]: k + 1 for k, r in enumerate(x for x in whole if x[1] == g)}
    assert got == want
    assert numbered(frame.where("1 = 0"), ["id"], ["g"]).collect() == []


def test_plans_gather_no_rows(spark):
    frame = spark.range(1000)
    plan = numbered(frame, ["id"], name="n")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1  # the partitions' counts, not rows


def test_folds_differ_by_one_row(spark):
    for n in (0, 3, 17, 20):
        frame = spark.range(n).select("id", (F.col("id") * F.col("id")).alias("t"), (F.col("id") * 3 % 7).alias("g"))
        found = histories.cross_validated(frame, ["id"], "t", "g", 5).first()
        assert found.folds == min(n, 5)
