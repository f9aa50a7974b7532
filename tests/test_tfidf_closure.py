"""TF-IDF vectors and their cosine join by brute force; closure with cycles and depth; duplicates explained by scope."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from driftloom.operators import closure, tfidf


def _docs():
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)] + ["été", "Straße"]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=rng.randint(1, 25)))) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " w59 extra") for i in range(0, 60, 2)] + [(300, rows[7][1]), (301, rows[7][1].upper()), (302, None), (303, ""), (304, "..."), (305, "only_here")]
    return rows


def _vectors(rows, fitted=None):
    import re

    tf = {i: Counter(re.findall(r"\w+", (t or "").lower())) for i, t in rows}
    df, n = Counter(), len(fitted or rows)
    for i, _ in fitted or rows:
        df.update(tf[i].keys())
    out = {}
    for i, c in tf.items():
        w = {t: k * (math.log((1 + n) / (1 + df[t])) + 1) for t, k in c.items() if t in df}
        size = math.sqrt(sum(x * x for x in w.values()))
        if size:
            out[i] = {t: x / size for t, x in w.items()}
    return out


@pytest.mark.parametrize("small", [10**6, 0])
def test_transform_of_other_rows(spark, monkeypatch, small):
    monkeypatch.setattr(tfidf, "SMALL", small)
    rows = _docs()
    frame = spark.createDataFrame(rows, "id long, text string").repartition(3)
    fitted = [r for r in rows if r[0] % 2 == 0]
    vocabulary = tfidf.fit(frame.where("id % 2 = 0"), "id", "text")
    got = {(r.key, r.term): r.weight for r in tfidf.transform(frame, "id", "text", vocabulary).collect()}
    assert got == pytest.approx({(i, t): w for i, v in _vectors(rows, fitted).items() for t, w in v.items()})
    few = {r.term: r.df for r in tfidf.fit(frame, "id", "text", least=3, most=0.2).collect()}
    assert few and all(3 <= n <= 0.2 * len(rows) for n in few.values())


@pytest.mark.parametrize("least", [0.3, 0.7, 0.9])
def test_no_pair_is_lost(spark, least):
    rows = _docs()
    frame = spark.createDataFrame(rows, "id long, text string").repartition(3)
    weights = tfidf.transform(frame, "id", "text", tfidf.fit(frame, "id", "text"))
    got = {(r.a, r.b): r.similarity for r in tfidf.pairs(weights, least).collect()}
    vectors, firsts = _vectors(rows), {}
    for i in sorted(vectors):
        firsts.setdefault(tuple(sorted((t, round(w, 9)) for t, w in vectors[i].items())), i)
    keys = sorted(firsts.values())
    want = {}
    for x, i in enumerate(keys):
        for j in keys[x + 1 :]:
            dot = sum(w * vectors[j].get(t, 0) for t, w in vectors[i].items())
            if round(dot, 6) >= least:
                want[i, j] = round(dot, 6)
    assert want and got == pytest.approx(want, abs=2e-6)
    assert {r.key: r.class_id for r in tfidf.classes(weights).collect()}[300] == 7


@pytest.mark.parametrize("dense", [0.0, 0.05, 1.0])
def test_grid_of_blocks(spark, monkeypatch, dense):
    monkeypatch.setattr(tfidf, "BLOCK", 40)
    monkeypatch.setattr(tfidf, "STEP", 60)
    monkeypatch.setattr(tfidf, "DENSE", dense)
    rows = [(i, f"all of these share one rare word {'x' * (i % 7)} own{i} own{i} own{i}") for i in range(150)] + [(1000 + i, f"near text {i // 2} of a pair{i // 2}" + " more" * (i % 2)) for i in range(40)]
    weights = tfidf.transform(spark.createDataFrame(rows, "id long, text string"), "id", "text", tfidf.fit(spark.createDataFrame(rows, "id long, text string"), "id", "text"))
    got = {(r.a, r.b): r.similarity for r in tfidf.pairs(weights, 0.6).collect()}
    vectors = _vectors(rows)
    want = {(i, j): s for i in vectors for j in vectors if i < j and (s := round(sum(w * vectors[j].get(t, 0) for t, w in vectors[i].items()), 6)) >= 0.6}
    assert want and got == pytest.approx(want, abs=2e-6)


def test_vectors_are_sent_packed(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k) - 3, rng.permutation(50_000)[: rng.integers(0, 300)].tolist(), int(k) % 2) for k in range(200)]
    rows = [(k, ids, rng.random(len(ids)).tolist(), block) for k, ids, block in rows]
    form = pa.schema([("key", pa.int64()), ("ids", pa.list_(pa.int32())), ("weights", pa.list_(pa.float32())), ("block", pa.int32())])
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), form)], schema=form)
    whole = pa.Table.from_batches(list(tfidf._pack(iter([batch]))))
    assert sum(map(len, whole.column("data").to_pylist())) < 0.7 * batch.nbytes
    got = {}
    for r in whole.to_pylist():
        keys, at, ids, weights = tfidf._side(pa.Table.from_pylist([r], whole.schema))
        for n, k in enumerate(keys.tolist()):
            got[k] = (r["block"], dict(zip(ids[at == n].tolist(), weights[at == n].tolist())))
    assert len(got) == 200
    for k, ids, weights, block in rows:
        assert got[k][0] == block and got[k][1] == pytest.approx(dict(zip(ids, weights)), rel=5e-4, abs=1e-6)


def test_empty_tables(spark):
    frame = spark.createDataFrame([], "id long, text string")
    weights = tfidf.transform(frame, "id", "text", tfidf.fit(frame, "id", "text"))
    assert weights.collect() == [] and tfidf.pairs(weights, 0.5).collect() == []
    assert closure.closure(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_closure_ends_on_cycles_and_has_no_cap(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1001), (1001, 1002), (1002, 1000), (1002, 1003), (7, 7), (None, 3), (3, None), (1, 2)]
    got = {(r.src, r.dst) for r in closure.closure(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {(a, b) for a in range(301) for b in range(a + 1, 301)} | {(7, 7)} | {(a, b) for a in (1000, 1001, 1002) for b in (1000, 1001, 1002, 1003)}
    assert got == want


def test_scope_explains_some_duplicates(spark):
    f = lambda name, owner, structure, path="m.py", decorators=(): (path, name, owner, list(decorators), structure)
    rows = [
        f("area", "Child", "s1"), f("area", "Top", "s1"),  # an ancestor two levels up
        f("area", "Child", "s2"), f("area", "Other", "s2"), f("area", "Third", "s2"),
        f("run", "A", "s3"), f("run", "B", "s3"), f("run", "A", "s4"), f("run", "A", "s4", "n.py"),
        f("get_x", "A", "s5"), f("get_y", "B", "s5"), f("get_x", None, "s6"), f("get_y", None, "s6"),
        f("__eq__", "A", "s7"), f("__eq__", "B", "s7"), f("size", "A", "s8", decorators=["abc.abstractmethod"]), f("size", "B", "s8"),
        f("helper", None, "s9"), f("helper", None, "s9", "n.py"), f("dumps", "A", "s10"), f("loads", "B", "s10"), f("alone", None, "s11"), f("validate", None, "s12"), f("clean", None, "s12"),
    ]
    functions = spark.createDataFrame(rows, "path string, name string, owner string, decorators array<string>, structure string")
    classes = spark.createDataFrame([("Child", ["pkg.Middle"]), ("Middle", ["Top", "Mixin"]), ("Top", []), ("Other", ["Top"]), ("Loop", ["Loop"])], "name string, bases array<string>")
    got = {r.structure: (r.copies, r.first, r.owners) for r in closure.true_duplicates(functions, classes).collect()}
    assert got == {"s2": (3, "m.py", 3), "s4": (2, "m.py", 1), "s6": (2, "m.py", 0), "s9": (2, "m.py", 0)}
