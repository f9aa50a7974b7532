"""Files below a folder, and ignore rules."""

import pytest
from pyspark.sql import functions as F

from driftloom.sources import code


def _tree(root, *names):
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"# {name}\n")


def _relative(frame):
    return sorted(r.relative for r in frame.collect())


def test_hidden_folders_count_below_the_root_only(spark, tmp_path):
    root = tmp_path / ".cache" / "__pycache__" / "my project"
    _tree(root, "a.py", "p/b.py", "p/__init__.py", "_in/f g.py", "p+q/h.py", "p/.hidden/c.py", "__pycache__/d.py", ".e.py", "p/note.txt")
    found = code.read(spark, str(root))
    every = [".e.py", "_in/f g.py", "a.py", "p+q/h.py", "p/__init__.py", "p/b.py"]
    assert _relative(found) == every and {r.relative for r in found.where("text = '# ' || relative || '\n'").collect()} == set(every)
    assert _relative(code.read(spark, f"file://{root}/")) == every


def test_include_exclude_and_ignore(spark, tmp_path):
    _tree(tmp_path, "a.py", "p/b.py", "p/q/c.py", "pq/d.py", "r/e.py")
    assert _relative(code.read(spark, str(tmp_path), include=["p", "a.py"])) == ["a.py", "p/b.py", "p/q/c.py"]
    assert _relative(code.read(spark, str(tmp_path), exclude=["p/q", "r"])) == ["a.py", "p/b.py", "pq/d.py"]
    assert _relative(code.read(spark, str(tmp_path), ignore=["# all", "", "p*/", "!p/q/", "/a.py"])) == ["p/q/c.py", "r/e.py"]


@pytest.mark.parametrize(
    ("patterns", "out", "kept"),
    [
        (["*.log", "!keep.log"], ["a.log", "x/b.log"], ["keep.log", "x/keep.log"]),
        (["!keep.log", "*.log"], ["keep.log"], ["a.py"]),
        (["build/"], ["build/a", "x/build/b"], ["build", "builds/a"]),
        (["/build"], ["build", "build/a"], ["x/build"]),
        (["a/*.py"], ["a/b.py"], ["a/c/b.py", "x/a/b.py"]),
        (["a/**/b.py"], ["a/b.py", "a/x/y/b.py"], ["c/a/b.py"]),
        (["**/b.py"], ["b.py", "x/y/b.py"], ["ab.py"]),
        (["a/**"], ["a/b", "a/b/c"], ["b/a"]),
        (["[a-c]?.py", "[!x]z"], ["a1.py", "cz.py", "az"], ["d1.py", "xz", "a11.py"]),
        ([r"\!odd", r"\#odd"], ["!odd", "#odd"], ["odd"]),
        (["a.b+c"], ["a.b+c"], ["axb+c", "a.bbc"]),
        (["", "  ", "# c"], [], ["c", "# c"]),
    ],
)
def test_ignore_rules(spark, patterns, out, kept):
    frame = spark.createDataFrame([(p,) for p in [*out, *kept]], "path string")
    got = {r.path: r.out for r in frame.select("path", code.ignored(F.col("path"), patterns).alias("out")).collect()}
    assert got == {p: p in out for p in [*out, *kept]}


def test_a_null_path(spark):
    assert spark.range(1).select(code.ignored(F.lit(None).cast("string"), ["*"]).alias("x")).first().x is None


def test_parsing_of_one_partition_is_dealt(spark):
    from driftloom.sources import code

    rows = [(f"f{k}.py", f"def f{k}(p):\n    return g{k % 3}(p, {k})\n") for k in range(40)]
    for facts in (code.facts(spark.createDataFrame(rows, "path string, text string").coalesce(1), "functions"), code.statuses(spark.createDataFrame(rows, "path string, text string").coalesce(1))):
        assert facts.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        assert sorted(r.path for r in facts.collect()) == sorted(p for p, _ in rows)
    found = code.facts(spark.createDataFrame(rows, "path string, text string"), "functions").select("structure").distinct().count()
    assert found == 1
