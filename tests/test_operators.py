"""Each registered query against its DuckDB twin, on the smallest tables; streams and sinks on their own."""

import os

import duckdb
import pandas as pd
import pytest

from driftloom.operators import graph
from driftloom.plans import registry
from driftloom.sources import sinks
from driftloom.sources.tables import TABLES
from driftloom.streaming import incremental

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
    return sorted((tuple(map(clean, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_query_equals_its_twin(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_every_twin_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (3, 9)], "src long, dst long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4, 7: 7}
    assert graph.components(edges.where("1 = 0")).count() == 0


def test_streams(spark, tmp_path):
    rows = "id long, ts timestamp, kind string"
    data = spark.sql("select id, timestamp'2024-01-01' + make_interval(0,0,0,0,0,id * 10,0) ts, if(id % 2 = 0, 'a', 'b') kind from range(12)")
    data.write.parquet(str(tmp_path / "in"))
    source = incremental.read(spark, str(tmp_path / "in"), rows)
    for n, frame in enumerate(
        (
            incremental.windowed_counts(source, "ts", "kind", "1 hour", "1 day"),
            incremental.session_chains(source, "kind", "ts", "30 minutes", "1 day"),
            incremental.first_seen(source, ["kind"], "ts", "1 day"),
        )
    ):
        mode = "append" if n == 2 else "complete"
        query = frame.writeStream.outputMode(mode).format("memory").queryName(f"out{n}").start()
        query.processAllAvailable()
        query.stop()
    assert spark.sql("select sum(events) from out0").first()[0] == 12
    assert spark.sql("select count(*) from out1").first()[0] == 2
    assert spark.sql("select count(*) from out2").first()[0] == 2


@pytest.mark.parametrize("kind", sinks.FORMATS)
def test_sinks(spark, tmp_path, kind):
    frame = spark.createDataFrame([(1, "a|b"), (2, None)], "id int, text string")
    sinks.write(frame, str(tmp_path / kind), kind)
    assert sorted(sinks.read(spark, str(tmp_path / kind), kind, frame.schema).collect()) == sorted(frame.collect())


def test_markdown(spark):
    frame = spark.createDataFrame([(1, "a|b"), (2, None)], "id int, text string")
    assert [r.line for r in sinks.markdown(frame).orderBy("id").collect()] == ["| 1 | a\\|b |", "| 2 |  |"]
