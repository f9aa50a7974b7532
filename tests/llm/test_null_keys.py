"""Documents without a key, and keys beyond 2**53, through the n-gram join and its pipeline stage."""

import corpus_pipeline
from driftloom.llm import ngram_join

BIG = 2**53 + 1
WORDS = [f"w{i}" for i in range(60)]


def _docs(spark):
    alone = [" ".join(f"{c}{w}" for w in WORDS) for c in "abcd"]
    rows = [(None, alone[0]), (None, alone[1]), (None, None), (None, ""), (BIG, alone[2]), (BIG + 1, alone[3]), (7, alone[2]), (2**63 - 1, "one two")]
    rows += [(None, alone[1]), (8, alone[0])]
    full = [(k, t, "en", "s", len(t or "")) for k, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


def test_join_gives_null_keys_back(spark):
    got = ngram_join.join(_docs(spark)).collect()
    assert sorted((r.doc_id for r in got if r.doc_id is not None)) == [7, 8, BIG, BIG + 1, 2**63 - 1]
    missing = [r for r in got if r.doc_id is None]
    assert len(missing) == 5
    assert len({r.component_id for r in missing}) == 4
    by_key = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert by_key[BIG] == by_key[7] == 7 and by_key[BIG + 1] == BIG + 1
    assert by_key[8] in {r.component_id for r in missing}


def test_keep_one_keeps_clean_rows_without_key(spark):
    docs = _docs(spark)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    texts = sorted((r.text or "", r.doc_id or 0) for r in kept.collect())
    alone = [" ".join(f"{c}{w}" for w in WORDS) for c in "abcd"]
    assert texts == sorted([("", 0), ("", 0), (alone[0], 0), (alone[1], 0), (alone[2], 7), (alone[3], BIG + 1), ("one two", 2**63 - 1)])
