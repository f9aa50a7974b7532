"""Rounding on decimal ties against the DuckDB twin, on rows of the tables where Spark's own rounding differs."""

import duckdb

from driftloom.plans import registry


def test_polymer_scores_round_ties_as_the_twin(spark, tmp_path):
    rows = [(1, 5, 85071.5, 47.0, 0.08, 0.01, "N", "O"), (2, 2, 64830.5, 46.0, 0.04, 0.05, "R", "F"), (3, 3, 29052.5, 35.0, 0.03, 0.08, "A", "F"), (4, 6, 42263.5, 39.0, 0.01, 0.01, "N", "O")]
    kinds = "l_orderkey long, l_linenumber int, l_extendedprice double, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted(map(tuple, registry.queries()["polymer_scores"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == sorted(con.sql(registry.oracle_sql()["polymer_scores"]).fetchall())
