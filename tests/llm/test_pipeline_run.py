"""The whole pipeline over a written table, each stage held against plain Python on its own input."""

import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from driftloom.llm import ngram_join, pii

regex = pytest.importorskip("regex")
tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
SPACE = regex.compile(r"[^\x20\x09-\x0D]+")


def _words(text):
    return SPACE.findall(text or "")


def _good(text):
    text = text or ""
    w = _words(text)
    n, chars = len(w), sum(map(len, w))
    windows = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    covered = {j for i in range(n - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    if n < 50 or 100 * len(covered) > 50 * n:
        return False
    lines = Counter(x for x in text.split("\n") if _words(x))
    repeated = sum(v - 1 for v in lines.values())
    letters, capitals = len(regex.findall(r"\p{L}", text)), len(regex.findall(r"\p{Lu}", text))
    symbols = len(regex.findall(r"[#*$%&|<>]", text))
    return not (
        10 * symbols > 3 * n or chars > 14 * n or chars < 2 * n or (repeated > 4 and 2 * repeated > text.count("\n"))
        or 2 * letters < chars or 2 * capitals > chars or 10 * text.count("!") > 4 * n
    )


def _firsts(rows):
    sets = {}
    for r in rows:
        w = r.text.encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {k: k for k in sets}
    for _ in sets:
        for a, x in sets.items():
            for b, y in sets.items():
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
    return {k for k, v in label.items() if k == v}


def _mixed(before, after):
    size, taken, source = {}, Counter(), {}
    for r in before:
        size[r.doc_id], source[r.doc_id] = len(_words(r.text)), r.source
    for r in after:
        taken[r.doc_id] += len(_words(r.text))
    for k, n in taken.items():
        assert n <= 2 * size[k]
    total = Counter()
    for k, n in size.items():
        total[source[k]] += n
    names = sorted((s for s in total if s is not None)) + [None] * (None in total)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, budget = {}, set(names), 1.5 * sum(total.values())
    while True:
        share = (budget - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * share > 2 * total[s]}
        if not over:
            break
        target |= {s: 2.0 * total[s] for s in over}
        left -= over
    target |= {s: weight[s] * share for s in left}
    got = Counter()
    for k, n in taken.items():
        got[source[k]] += n
    for s in names:
        assert abs(got[s] - target[s]) <= 1


def _packed(before, pieces):
    library = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    want, got, spots = Counter(), defaultdict(list), defaultdict(list)
    for r in before:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        for a in range(0, len(ids), 4096):
            own = ids[a : a + 4096]
            want[r.doc_id, a, len(own), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own)), len(ids)] += 1
    for r in pieces:
        got[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens].append(r)
        spots[r.sequence_id].append((r.offset, r.length))
    assert {k: len(v) for k, v in got.items()} == dict(want)
    for own in spots.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


@pytest.fixture
def recorded(monkeypatch):
    """STAGES that note the rows that each stage gets and gives."""
    seen = {}

    def noted(name, stage):
        def run(spark, docs, sf_dir):
            out = stage(spark, docs, sf_dir)
            seen[name] = (docs.collect(), out.collect())
            return out

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [noted(*s) for s in corpus_pipeline.STAGES])
    return seen


def test_run_equals_plain_python(spark, docs, tmp_path, recorded):
    docs.select(*corpus_pipeline.COLUMNS).dropDuplicates(["doc_id"]).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    before, after = recorded["quality_rules"]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if _good(r.text))
    before, after = recorded["near_duplicates"]
    assert {r.doc_id for r in after} == _firsts(before)
    assert {r.doc_id: r.text for r in after}.items() <= {r.doc_id: r.text for r in before}.items()
    before, after = recorded["personal_data"]
    texts = {r.doc_id: r.text for r in after}
    for r in before:
        assert "[" in texts[r.doc_id] or texts[r.doc_id] == r.text
        assert not regex.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", texts[r.doc_id])
    _mixed(*recorded["source_mixing"])
    before, pieces = recorded["sequence_packing"]
    _packed(before, pieces)
    key = lambda r: (r.doc_id, r.start, r.ids_crc32)
    assert sorted(map(key, final)) == sorted(map(key, pieces))


def test_run_takes_an_empty_table(spark, docs, tmp_path):
    docs.select(*corpus_pipeline.COLUMNS).where("1 = 0").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_take_nulls_and_clashing_names(spark, docs):
    odd = docs.limit(8).withColumnRenamed("kept", "_first").withColumnRenamed("hash", "_own").selectExpr("nullif(doc_id, 3) as doc_id", "* except (doc_id)")
    assert "_first" in ngram_join.keep_one(odd).columns
    assert pii.redact(odd).columns == odd.columns
