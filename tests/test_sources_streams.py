"""Report sinks, exported histories, source texts and stateful streams on small fixtures."""

import json
import xml.dom.minidom

import pytest
from pyspark.sql import functions as F

from driftloom.operators import detectors, models, signatures, vectors
from driftloom.sources import versions
from driftloom.sources import code, gitlog, reports
from driftloom.streaming import stateful

ISSUES = [(0, "dup<&>", 4, "a/b.py", 7, 'say "x"'), (1, None, 2, None, None, None), (2, "k", 5, "c.py", 0, "m|n")]


@pytest.fixture(scope="module")
def issues(spark):
    return spark.createDataFrame(ISSUES, "nth long, kind string, severity int, file string, line int, message string")


def _text(report):
    return "\n".join(r.line for r in report.orderBy("nth").collect())


def test_reports_are_well_formed(spark, issues, tmp_path):
    log = json.loads(_text(reports.sarif(issues, "nth", "message")))
    results = log["runs"][0]["results"]
    assert json.loads(_text(reports.sarif(issues.where("nth > 0"), "nth", "message")))["runs"][0]["results"] == results[1:]
    assert json.loads(_text(reports.sarif(issues.where("1 = 0"), "nth", "message")))["runs"][0]["results"] == []
    assert [r["level"] for r in results] == ["error", "note", "error"] and results[0]["message"]["text"] == 'say "x"'
    assert results[0]["locations"][0]["physicalLocation"]["region"]["startLine"] == 7
    suite = xml.dom.minidom.parseString(_text(reports.junit(issues, "nth", "message")))
    assert len(suite.getElementsByTagName("failure")) == 3
    nodes, edges = spark.createDataFrame([("a", "x<y"), ("b", None)], "id string, label string"), spark.createDataFrame([("a", "b", 2.0)], "src string, dst string, weight double")
    graph = xml.dom.minidom.parseString(_text(reports.graphml(nodes, edges)))
    assert len(graph.getElementsByTagName("node")) == 2 and len(graph.getElementsByTagName("edge")) == 1
    assert "N1 --> N2" in _text(reports.mermaid(issues, "nth", "kind"))
    assert "&lt;&amp;&gt;" in _text(reports.html(issues, "nth", ["kind", "file"], "t"))
    assert _text(reports.text(issues, "nth", "message")).split("\n")[1] == '[4] dup<&> a/b.py:7 say "x"'
    reports.write_lines(reports.junit(issues, "nth", "message"), str(tmp_path / "junit"))
    whole = "\n".join(p.read_text() for p in sorted((tmp_path / "junit").glob("part-*")))
    xml.dom.minidom.parseString(whole)
    assert reports.sarif(issues.where("1 = 0"), "nth", "message").count() == 2


def test_marks_that_xml_does_not_allow(spark):
    odd = spark.createDataFrame([(0, "k\x00", 3, "a\x01.py", 1, "bell \x07 tab \t smile \U0001f600 \ufffe end")], "nth long, kind string, severity int, file string, line int, message string")
    case = xml.dom.minidom.parseString(_text(reports.junit(odd, "nth", "message"))).getElementsByTagName("failure")[0]
    assert case.getAttribute("message").replace("\t", " ") == "bell \ufffd tab   smile \U0001f600 \ufffd end"


def test_replace_dataset(spark, tmp_path):
    folder = str(tmp_path / "set")
    for n in (3, 5, 7):
        reports.replace_dataset(spark.range(n), folder)
        assert reports.dataset(spark, folder).count() == n
    old = reports.dataset(spark, folder)
    with pytest.raises(FileExistsError):
        versions.commit(spark, folder, 2, {"data": "other"})
    spark.range(9).write.parquet(f"{folder}/data-crashed")  # written, never committed
    assert reports.dataset(spark, folder).count() == 7
    reports.replace_dataset(spark.range(11), folder)
    assert old.count() == 7 and reports.dataset(spark, folder).count() == 11
    assert len([p for p in (tmp_path / "set").iterdir() if p.name.startswith("data-")]) == 3


LOG = "abcdef1|Ann|1000|fix import|again\nM\ta.py\nA\tb.py\n\nabcdef2|Bob|90000|Add tests for parser\n3\t1\ta.py\n-\t-\tc.bin\n\nabcdef3|Cy|90001|tidy\n"


def test_git_log(spark):
    logs = spark.createDataFrame([(LOG,), (None,), ("",)], "log string")
    found = gitlog.commits(logs)
    assert [(r.hash, r.author, r["at"], r.message) for r in found.orderBy("at").collect()] == [
        ("abcdef1", "Ann", 1000, "fix import|again"), ("abcdef2", "Bob", 90000, "Add tests for parser"), ("abcdef3", "Cy", 90001, "tidy"),
    ]
    assert [r.hash for r in found.where(gitlog.suspicious(F.col("message"))).orderBy("at").collect()] == ["abcdef1", "abcdef3"]
    files = gitlog.files(found)
    assert sorted((r.hash, r.status or "", r.added or 0, r.path) for r in files.collect()) == [
        ("abcdef1", "A", 0, "b.py"), ("abcdef1", "M", 0, "a.py"), ("abcdef2", "", 0, "c.bin"), ("abcdef2", "", 3, "a.py"),
    ]
    assert tuple(gitlog.line_totals(files).first()) == (3, 1, 3)
    life = {r.path: (r.created, r.modified) for r in gitlog.lifetimes(files).collect()}
    assert life["a.py"] == (1000, 90000)
    assert gitlog.since(found, 90001, 1).count() == 2


def test_source_facts(spark, tmp_path):
    (tmp_path / "pkg" / ".hidden").mkdir(parents=True)
    (tmp_path / "pkg" / "a.py").write_text("from . import b\n\nclass A(B):\n    async def f(self, x):\n        '''TODO'''\n\n    @abc.abstractmethod\n    def g(self): ...\n")
    (tmp_path / "pkg" / ".hidden" / "c.py").write_text("x = 1")
    (tmp_path / "pkg" / "d.txt").write_text("no")
    read = code.read(spark, str(tmp_path))
    assert read.count() == 1
    found = {r.name: r for r in code.facts(read, "functions").collect()}
    assert found["f"].body == "todo" and found["f"].is_async and found["f"].owner == "A" and found["g"].body == "ellipsis"
    assert [r.name for r in detectors.real_placeholders(code.facts(read, "functions")).collect()] == ["f"]
    assert code.facts(read, "imports").first().level == 1
    odd = spark.createDataFrame([("n", None), ("e", ""), ("b", "﻿x\t= 1\0\n"), ("q", "(((")], "path string, text string")
    status = {r.path: r.status for r in code.statuses(odd).collect()}
    assert status["n"] == status["e"] == "parsed" and status["b"] == "repaired" and status["q"] in ("recovered", "quarantined")
    for kind in ("functions", "classes", "imports", "calls", "undefined"):
        assert code.facts(odd.where("1 = 0"), kind).count() == 0


def test_cells_of_several_blocks_equal_one(spark, monkeypatch):
    rows = spark.range(60).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.col("id") * i).cast("float")).alias("v"), (F.col("id") % 3).cast("int").alias("g"))
    whole = [
        sorted(map(tuple, f().collect()))
        for f in (
            lambda: vectors.top_k(rows.where("id % 7 = 0"), rows, "id", "v", 4), lambda: vectors.label_pairs(rows, "id", "v", "g", 0.2),
            lambda: vectors.distances(rows, "id", "v", "g"), lambda: vectors.group_counts(rows, "id", "v", "g", 0.2),
        )
    ]
    monkeypatch.setattr(vectors, "BLOCK", 7)
    cut = [
        sorted(map(tuple, f().collect()))
        for f in (
            lambda: vectors.top_k(rows.where("id % 7 = 0"), rows, "id", "v", 4), lambda: vectors.label_pairs(rows, "id", "v", "g", 0.2),
            lambda: vectors.distances(rows, "id", "v", "g"), lambda: vectors.group_counts(rows, "id", "v", "g", 0.2),
        )
    ]
    assert whole == cut and all(whole)
    assert vectors.background(rows.where("1 = 0"), "id", "v", "g").first().pairs == 0


def test_bands_follow_the_threshold():
    assert signatures.bands_rows(128, 0.5) == (16, 8) and signatures.bands_rows(128, 0.7) == (8, 16) and signatures.bands_rows(128, 0.3) == (32, 4)
    assert signatures.bands_rows(8, 0.5) == (8, 1)


def _run(spark, frame, name, mode="append"):
    query = frame.writeStream.outputMode(mode).format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


@pytest.fixture
def source(spark, tmp_path):
    data = spark.sql("select id, timestamp'2024-01-01' + make_interval(0,0,0,0,0,id,0) ts, if(id % 4 = 0, 'a', 'b') kind, cast(id as double) value, id % 3 = 0 ok from range(23)")
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))


def test_stateful_streams(spark, source, tmp_path):
    assert sorted(tuple(r) for r in _run(spark, stateful.throttled(source, "kind"), "t1")) == [("a", 1), ("a", 5), ("b", 1), ("b", 5), ("b", 10), ("b", 15)]
    moved = {(r.key, r.value): r.moved for r in _run(spark, stateful.buffered(source, "kind", "ts", "value"), "t2")}
    assert moved["a", 0.0] is None and moved["a", 8.0] == 4.0 and len(moved) == 23
    counts = {r.key: (r.tries, r.successes, r.failures) for r in _run(spark, stateful.counters(source, "kind", "ok"), "t3", "complete")}
    assert counts == {"a": (6, 2, 4), "b": (17, 6, 11)}


def test_silent_keys(spark, tmp_path):
    late = spark.sql("select if(id < 3, 'gone', 'here') key, timestamp'2024-01-01' + make_interval(0,0,0,0,id,0,0) ts from range(8)")
    late.where("key = 'gone'").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(late.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stateful.silent(stream, "key", "ts", "2 hours", "1 minute").writeStream.outputMode("append").format("memory").queryName("t4").start()
    query.processAllAvailable()
    late.where("key = 'here'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query.processAllAvailable()
    spark.sql("select 'here' key, timestamp'2024-01-01 09:00:00' ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query.processAllAvailable()
    query.stop()
    assert "gone" in [r.key for r in spark.table("t4").collect()]


def test_upserts(spark, tmp_path):
    folder, inbox = str(tmp_path / "table"), str(tmp_path / "in")
    rows = "id long, v int, gone boolean"
    write = stateful.upserted(spark, folder, "id", "v", "gone")
    parts = [
        ([(1, 1, False), (2, 1, False)], [(1, 1, False), (2, 1, False)]),
        ([(1, 2, False), (2, 2, True), (3, 1, None)], [(1, 2, False), (3, 1, False)]),
        ([(1, 3, True), (None, 9, False)], [(3, 1, False)]),
        ([(1, 2, False), (2, 1, False)], [(3, 1, False)]),  # late rows bring nothing back
        ([(1, 3, False), (2, 3, False)], [(2, 3, False), (3, 1, False)]),
    ]
    for part, want in parts:
        spark.createDataFrame(part, rows).coalesce(1).write.mode("append").parquet(inbox)
        stateful.run_once(spark.readStream.schema(rows).parquet(inbox), write, str(tmp_path / "check"))
        assert sorted(tuple(r) for r in stateful.current(spark, folder, "gone").collect()) == want


def test_upserts_rewrite_only_what_they_touch(spark, tmp_path):
    folder = str(tmp_path / "table")
    write = stateful.upserted(spark, folder, "id", "v", "gone", 16)
    frame = lambda rows: spark.createDataFrame(rows, "id long, v int, gone boolean")
    write(frame([(i, 1, False) for i in range(200)]), 0)
    before = versions.read(spark, folder, 0)["buckets"]
    write(frame([(5, 2, False)]), 1)
    write(frame([(5, 3, False)]), 1)  # a batch that was committed
    after = versions.read(spark, folder, versions.numbers(spark, folder)[-1])["buckets"]
    assert len(before) == 16 and sum(before[b] != after[b] for b in before) == 1
    got = {r.id: r.v for r in stateful.current(spark, folder, "gone").collect()}
    assert got == {i: 2 if i == 5 else 1 for i in range(200)}


def test_forest_tells_risk(spark):
    rows = spark.range(400).select(((F.col("id") * 37) % 100).cast("double").alias("x"), ((F.col("id") * 11) % 7).cast("double").alias("z"))
    rows = rows.withColumn("y", (F.col("x") > 60).cast("int"))
    model = models.train_forest(rows, ["x", "z"], "y", 10)
    asked = spark.createDataFrame([(95.0, 1.0), (5.0, 1.0), (None, 1.0)], "x double, z double")
    risk = {r.x: r.risk for r in models.predict_risk(model, asked, ["x", "z"]).collect()}
    assert risk[95.0] > 0.9 and risk[5.0] < 0.1 and risk[None] is None
