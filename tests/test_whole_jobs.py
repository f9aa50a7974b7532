"""Queries that do the whole job where a twin's SQL bounds the older one, against brute force."""

import math
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from driftloom.operators import dedup, domains, graph
from driftloom.plans import registry

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_every_edge_falls_in_a_domain(spark):
    ends = duckdb.sql(f"select l_suppkey a, l_partkey b from '{SF}/lineitem.parquet'").df()
    got = {r.kind: r for r in registry.queries()["domain_interval_stats_all"](spark, SF).collect()}
    intra = ends.a // 600 == ends.b // 600
    for kind, some in (("intra", ends[intra]), ("inter", ends[~intra])):
        apart = (some.a - some.b).abs()
        assert got[kind].contacts == len(some) > 0
        assert got[kind]["mean"] == pytest.approx(apart.mean(), abs=1e-4)
        assert got[kind].deviation == pytest.approx(apart.std(ddof=0), abs=1e-4)
    assert sum(r.contacts for r in got.values()) == len(ends)


def test_domains_cover_any_id(spark):
    pairs = spark.createDataFrame([(-1, 0), (-600, -1), (599, 0), (600, 599), (10**12, 10**12 + 1), (550, 560), (None, 1)], "a long, b long")
    got = {r.kind: r.contacts for r in domains.width_contacts(pairs, 600, "a", "b").collect()}
    assert got == {"inter": 2, "intra": 4}


def _influence(ends, hops):
    back, reached, weight = defaultdict(set), Counter(), Counter()
    for a, b in ends:
        back[b].add(a)
    for node in back:
        seen, front = {node}, {node}
        for hop in range(1, hops + 1):
            front = set().union(*(back.get(x, set()) for x in front)) - seen
            seen |= front
            reached[node] += len(front)
            weight[node] += len(front) / hop
    return {k: (n, pytest.approx(weight[k], abs=1e-4)) for k, n in reached.items() if n}


def test_influence_reaches_three_hops(spark):
    ends = duckdb.sql(f"select distinct l_suppkey a, l_partkey b from '{SF}/lineitem.parquet'").df()
    got = {r.node: (r.reached, r.influence) for r in registry.queries()["influence_3hop"](spark, SF).collect()}
    assert got == _influence(list(zip(ends.a.tolist(), ends.b.tolist(), strict=True)), 3)


def test_influence_of_a_chain(spark):
    chain = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 3)]
    got = {r.node: (r.reached, r.influence) for r in graph.influence(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert got == _influence(chain, 3)
    assert got[4] == (4, pytest.approx(1 + 1 / 2 + 1 / 2 + 1 / 3, abs=1e-4))


@pytest.mark.parametrize("hops", [1, 2, 3, 4])
def test_influence_in_blocks_and_shares(spark, monkeypatch, hops):
    for name, value in (("_EDGES", 60), ("_BALLS", 90), ("_WIDE", 16)):
        monkeypatch.setattr(graph, name, value)
    rng = random.Random(8)
    ends = [(rng.randrange(90), rng.randrange(60) - 9) for _ in range(300)] + [(k, 5) for k in range(80)] + [(2**40, 1), (1, 2**40), (3, 3)]
    frame = spark.createDataFrame([*ends, (None, 4), (4, None), *ends[:9]], "src long, dst long")
    assert {r.node: (r.reached, r.influence) for r in graph.influence(frame, hops).collect()} == _influence(ends, hops)


def test_edges_of_influence_are_lists(spark, monkeypatch):
    sent, step = [], graph._step_back

    def held(edges, reach, counted):
        sent.append(edges.count())
        return step(edges, reach, counted)

    monkeypatch.setattr(graph, "_step_back", held)
    got = graph.influence(spark.createDataFrame([(s, d) for s in range(60) for d in range(5)] * 2, "src long, dst long"), 2)
    assert {(r.node, r.reached, r.influence) for r in got.collect()} == {(d, 59, 59.0) for d in range(5)}
    assert sent == [5]


def test_influence_of_no_edges(spark):
    assert graph.influence(spark.createDataFrame([], "src long, dst long")).collect() == []


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _close(names, most):
    return sorted((a, b, _edits(a, b)) for a in names for b in names if a < b and _edits(a, b) <= most)


def test_edit_pairs_lose_none(spark):
    names = [r[0] for r in duckdb.sql(f"select distinct p_name from '{SF}/part.parquet'").fetchall()]
    got = registry.queries()["name_levenshtein_all_pairs"](spark, SF).collect()
    assert sorted(map(tuple, got)) == _close(names, 5)


@pytest.mark.parametrize("most", [0, 1, 3])
def test_edit_pairs_of_short_and_odd_names(spark, most):
    rng = random.Random(4)
    names = {"".join(rng.choice("abé") for _ in range(rng.randint(0, 9))) for _ in range(70)} | {"\U0001d11eab", "ab", "xab"}
    rows = spark.createDataFrame([(n,) for n in [*names, None, "ab"]], "name string")
    assert sorted(map(tuple, dedup.edit_pairs(rows, "name", most).collect())) == _close(names, most)


def _similar(table, key, threshold):
    rows = duckdb.sql(f"select {key}, coalesce(text, '') from '{SF}/{table}.parquet'").fetchall()
    sets = [(k, frozenset(re.findall(r"\w+", t.lower()))) for k, t in rows]
    pairs = {}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            small, large = sorted((len(x), len(y)))
            if small >= threshold * large:
                share = len(x & y) / len(x | y) if large else 1.0
                if round(share, 6) >= threshold:
                    pairs[min(a, b), max(a, b)] = pytest.approx(share, abs=1e-6)
    return pairs


@pytest.mark.parametrize(("name", "table", "key", "threshold"), [
    ("lsh_document_pairs", "documents", "doc_id", 0.8), ("lsh_benchmark_pairs", "benchmark", "item_id", 0.1),
])
def test_banding_recalls_the_exact_pairs(spark, name, table, key, threshold):
    want = _similar(table, key, threshold)
    got = {(r.a, r.b): r.similarity for r in registry.queries()[name](spark, SF).collect()}
    assert want and all(want.get(k) == v for k, v in got.items())
    assert len(got) >= 0.99 * len(want)


def test_bands_follow_the_threshold():
    assert [dedup.band_rows(t) for t in (0.8, 0.1, 1.0)] == [5, 1, 100]


def test_signatures_are_made_in_arrow_maps(spark):
    rows = spark.createDataFrame([(1, "a b c d e f é"), (2, "A b c d e f é"), (3, "x y"), (4, None), (5, ""), (6, "x z")], "id long, text string")
    pairs = dedup.similar_pairs(rows, "id", "text", 0.8)
    assert "MapInArrow" in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, pairs.collect())) == [(1, 2, 1.0), (4, 5, 1.0)]


@pytest.mark.parametrize("sent", [10**6, 0])
def test_copies_are_verified_once(spark, monkeypatch, sent):
    monkeypatch.setattr(dedup, "SENT", sent)
    base = [f"w{k}" for k in range(40)]
    texts = [" ".join(base)] * 30 + [" ".join([*base, "more"])] * 30 + ["another text"] * 3 + ["lonely"] + [None] * 2
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    seen, alike = spark.sparkContext.accumulator(0), dedup._alike

    def counted(threshold):
        run = alike(threshold)

        def each(batches):
            for batch in batches:
                seen.add(len(batch))
                yield from run(iter([batch]))

        return each

    monkeypatch.setattr(dedup, "_alike", counted)
    got = {(r.a, r.b): r.similarity for r in dedup.similar_pairs(rows, "id", "text", 0.8).collect()}
    want = {(a, b): 1.0 for a in range(66) for b in range(a + 1, 66) if texts[a] == texts[b]} | {(a, b): round(40 / 41, 6) for a in range(30) for b in range(30, 60)}
    assert got == want and seen.value == 1


def test_words_of_any_script_count(spark):
    rows = duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet'").fetchall()
    counts = {k: Counter(re.findall(r"\w+", t.lower())) for k, t in rows}
    df, uses = Counter(), Counter()
    for c in counts.values():
        df.update(c.keys())
        uses.update(c)
    got = registry.queries()["word_df"](spark, SF).collect()
    assert {r.term: (r.df, r.uses) for r in got} == {w: (n, uses[w]) for w, n in df.items()}
    assert any(not w.isascii() for w in df)
    for r in registry.queries()["word_tfidf_topk"](spark, SF).where("doc_id % 20 = 0").collect():
        weight = {w: n * (math.log((1 + len(rows)) / (1 + df[w])) + 1) for w, n in counts[r.doc_id].items()}
        assert r.weight == pytest.approx(weight[r.term], abs=1e-4)
        assert sum(v > r.weight + 1e-3 for v in weight.values()) < r.nth
    entropy = {r.doc_id: r.words for r in registry.queries()["word_entropy_all"](spark, SF).collect()}
    assert entropy == {k: c.total() for k, c in counts.items() if c}


def test_recall_of_bucket_neighbours(spark):
    got = {(r["query"], r.vec_id) for r in registry.queries()["bucket_neighbours"](spark, SF).collect()}
    exact = {(r.a, r.b) for r in registry.queries()["cosine_topk"](spark, SF).collect()}
    assert len(got & exact) >= 0.9 * len(exact)
