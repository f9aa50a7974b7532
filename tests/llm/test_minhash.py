"""MinHash near-duplicates: the index's promise on signatures, and components by brute force."""

import random

import numpy as np
import pytest

from driftloom.llm import minhash as m
from driftloom.llm.ngram_join import shingles


def test_every_pair_within_the_distance_shares_a_key():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << m.BITS, (400, m.SYMBOLS)).astype(np.uint16)
    for errors in (0, 1, m.CHUNKS, m.DISTANCE):
        other = base.copy()
        for row in other:
            at = rng.choice(m.SYMBOLS, errors, replace=False)
            row[at] ^= rng.integers(1, 1 << m.BITS, errors).astype(np.uint16)
        assert all(np.intersect1d(a, b).size for a, b in zip(m.keys(base), m.keys(other), strict=True))
    far = rng.integers(0, 1 << m.BITS, (400, m.SYMBOLS)).astype(np.uint16)
    assert not any(np.intersect1d(a, b).size for a, b in zip(m.keys(base), m.keys(far), strict=True))


def test_signatures_follow_the_sets():
    texts = [b"a b c d e f g h", b"A  b c\td e f g h", b"x y", b""]
    rows = m.signatures(shingles(texts, 3))
    assert (rows[0] == rows[1]).all() and (rows[0] != rows[2]).any() and not rows[3].any()


def _set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) >= 3 else ({tuple(words)} if words else set())


def _brute(rows):
    sets = [(i, _set(t)) for i, t in rows]
    label = {i: i for i, _ in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            both = len(a & b)
            if both and 100 * both >= 85 * (len(a) + len(b) - both):
                u, v = sorted((root(i), root(j)))
                label[v] = u
    return {(i, len(s), root(i), root(i) == i) for i, s in sets}


def _near_copies():
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for size, changes in ((120, 3), (200, 7), (200, 9), (60, 2), (400, 30)):
        base = [word() for _ in range(size)]
        for _ in range(40):
            copy = list(base)
            for _ in range(rng.randint(0, changes)):
                copy[rng.randrange(size)] = word()
            rows.append(" ".join(copy))
    passage = " ".join(word() for _ in range(80))
    rows += [passage + " " + " ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(60)]
    chain = [word() for _ in range(150)]
    for k in range(12):  # each is near the next, the ends are far apart
        rows.append(" ".join(chain[6 * k :] + [word() for _ in range(6 * k)]))
    rng.shuffle(rows)
    return [(7 * i, t) for i, t in enumerate(rows)]


def _got(found):
    return {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found.collect()}


def test_components_equal_brute_force(spark):
    rows = _near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert _got(m.near_duplicates(docs)) == _brute(rows)


def test_products_of_keys_find_what_stars_miss(spark, monkeypatch):
    monkeypatch.setattr(m, "CLOSE", 101)  # nothing is a star's member, so all other pairs come from the keys
    monkeypatch.setattr(m, "KEY_BLOCK", 7)
    rows = _near_copies()[:150]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert _got(m.near_duplicates(docs)) == _brute(rows)


def test_nulls_ties_repeats_and_names(spark, docs, plain, empty):
    found = m.near_duplicates(docs)
    assert found.columns == ["doc_id", "n_shingles", "class_id", "component_id", "kept"]
    assert sorted(r.doc_id for r in found.collect()) == [i for i, _, _ in plain]
    assert _got(found) == _brute(list({i: t for i, t, _ in plain}.items()))
    assert m.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("text", ["same words in both of these rows", None])
def test_null_keys(spark, text):
    docs = spark.createDataFrame([(None, text), (None, text), (4, text)], "doc_id long, text string")
    got = m.near_duplicates(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == ["4", "None", "None"]
    if text:
        assert len({r.component_id for r in got}) == 1
