"""Fingerprints, likenesses and rule order against plain Python; removal of repeats with null keys and over cuts."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from driftloom.llm import fingerprints as fp
from driftloom.llm import quality, suffix_dedup


def _levels(raw):
    out = []
    for i in range(len(raw) - fp.WINDOW + 1):
        # the same sum as the operator's, so that ties round alike
        total = sum(n * math.log2(n) for n in Counter(raw[i : i + fp.WINDOW]).values())
        entropy = math.log2(fp.WINDOW) - float(np.float32(total)) / fp.WINDOW
        out.append(min(max(round(entropy * fp.LEVELS / math.log2(fp.WINDOW)), 0), fp.LEVELS))
    return out


def _hash(window):
    code = 0
    for byte in window:
        code = (code * int(fp._STEP) + int(fp._HASH[byte])) % 2**64
    return code ^ (code >> 29)


def _print(raw, rank):
    levels, found = _levels(raw), []
    n = len(levels)
    if n:
        run = min(fp.RUN, n)
        votes = Counter(min(range(s, s + run), key=lambda p: (rank[levels[p]], p)) for s in range(n - run + 1))
        need = min(fp.VOTES, n - run + 1)
        found = [_hash(raw[p : p + fp.WINDOW]) for p in range(n) if votes[p] >= need and rank[levels[p]] <= fp.LEVELS]
    if not found and raw:
        found = [int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")]
    unique, filters = list(dict.fromkeys(found)), []
    for a in range(0, len(unique), fp.PER_FILTER):
        own = unique[a : a + fp.PER_FILTER]
        filters.append((len(own), {(h * (0x9E3779B97F4A7C15 * k % 2**64) % 2**64) >> 53 for h in own for k in range(1, 2 * fp.PROBES, 2)}))
    return filters


def _likeness(a, b):
    if not a or not b:
        return float(not a and not b)
    if [x for _, x in a] == [x for _, x in b]:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    total = 0
    for n, x in a:
        best = 0
        for _, y in b:
            chance, full = len(x) * len(y) / fp.FILTER_BITS, min(len(x), len(y))
            best = max(best, min(max((len(x & y) - chance) / max(full - chance, 1e-9), 0), 1))
        total += n * best
    return total / sum(n for n, _ in a)


def _bits(text):
    return [(n, set(np.flatnonzero(bits).tolist())) for n, bits in fp.decode(text)]


def test_features_do_not_depend_on_cuts(plain, monkeypatch):
    texts, rank = [t.encode() for _, t, _ in plain] + [b"a" * 900], fp.ranks(np.arange(fp.LEVELS + 1) % 77)
    whole = fp.features(texts, rank)
    for size in (300, 64):
        monkeypatch.setattr(fp, "CHUNK_BYTES", size)
        assert all((a == b).all() for a, b in zip(whole, fp.features(texts, rank), strict=True))


def test_fingerprints_equal_plain_python(docs, plain):
    counts = Counter(x for _, t, _ in plain for x in _levels(t.encode()))
    found = fp.histogram(docs)
    assert {k: int(n) for k, n in enumerate(found) if n} == dict(counts)
    rank = fp.ranks(found).tolist()
    order = sorted(((k, t) for k, t, _ in plain), reverse=True)
    texts = [t for _, t in order]
    own = [_print(t.encode(), rank) for t in texts]
    got = sorted(fp.compare(docs, counts=found).collect(), key=lambda r: (r.doc_id, r.n_chars), reverse=True)
    for i, r in enumerate(got):
        following = (i + 1) % len(texts)
        third = len(texts[i]) // 3
        edited = _print((texts[i][: len(texts[i]) - third] + texts[following][:third]).encode(), rank)
        assert _bits(r.fingerprint) == own[i] and _bits(r.edited_fingerprint) == edited
        assert abs(r.near_edited - _likeness(own[i], edited)) < 1e-5
        assert abs(r.near_next - _likeness(own[i], own[following])) < 1e-5


def test_rules_run_by_rejection_per_cost(docs):
    a, b, c = (quality.Rule(n, "false") for n in "abc")
    assert [r.name for r, _, _ in quality.by_worth([(a, 1.0, 0.2), (b, 0.1, 0.1), (c, 0.5, 0.0)])] == ["b", "a", "c"]
    slow = " or ".join(f"length(regexp_replace(text, '(?i)([a-z]+ ){{{k}}}x', '')) < 0" for k in range(2, 8))
    rules = (quality.Rule("slow", f"({slow}) or n_words > 3"), quality.Rule("fast", "n_words > 3"))
    wide = docs
    for _ in range(4):
        wide = wide.unionByName(wide)
    found = quality.plan_cascade(wide, rules)
    assert [r.name for r, _, _ in found] == ["fast", "slow"] and found[0][1] < found[1][1] and found[0][2] == found[1][2] > 0
    assert [r.name for r, _, _ in quality.plan_cascade(docs.where("1 = 0"), rules)] == ["slow", "fast"]


def test_anchors_do_not_depend_on_cuts(plain, monkeypatch):
    texts = [t.encode() for _, t, _ in plain]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])

    def owners():
        anchor, first, count, doc, _ = suffix_dedup.stretches(data, ends)
        places = suffix_dedup._spread(first, count)
        assert (places + suffix_dedup.LENGTH <= ends[np.repeat(doc, count)]).all()
        return dict(zip(places.tolist(), np.repeat(anchor, count).tolist(), strict=True))

    whole = owners()
    assert len(whole) == sum(max(len(t) - 49, 0) for t in texts)
    windows = {}
    for at, anchor in whole.items():
        assert windows.setdefault(data[at : at + 50].tobytes(), anchor) == anchor
    monkeypatch.setattr(suffix_dedup, "_PIECE", 64)
    assert owners() == whole


def test_suffix_dedup_with_null_keys(spark):
    passage = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(400))
    rows = [(None, passage[:300]), (None, "z" + passage[:300]), (5, "y" * 30 + passage), (9, passage[100:] + "é" * 40), (9, passage[100:]), (2**60, ""), (2**60 + 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = {}
    plain = [(-(2**63) if k is None else k, (t or "").encode()) for k, t in rows]
    for k, raw in plain:
        for p in range(len(raw) - 49):
            first[raw[p : p + 50]] = min(k, first.get(raw[p : p + 50], k))
    want = []
    for (k, _), (key, raw) in zip(rows, plain, strict=True):
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < key:
                gone[p : p + 50] = True
        want.append((k, len(raw), int(gone.sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.dedup(docs, digest=True).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
