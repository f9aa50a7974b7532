import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from driftloom.llm import fingerprints, ngram_join, packing, suffix_dedup, token_counts, token_files

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def ids(plain, library):
    return [(k, np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")) for k, t, _ in plain]


def test_suffix_dedup(docs, plain, empty, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup, "COLUMN_BYTES", 2000)
    first, want = {}, []
    for k, t, _ in plain:
        raw = t.encode()
        for p in range(len(raw) - 49):
            first[raw[p : p + 50]] = min(k, first.get(raw[p : p + 50], k))
    for k, t, _ in plain:
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < k:
                gone[p : p + 50] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(gone) else 0
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        want.append((k, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    assert sorted(tuple(r) for r in suffix_dedup.dedup(docs, digest=True).collect()) == sorted(want)
    assert suffix_dedup.dedup(empty).count() == 0
    # hot anchors go window by window
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    assert sorted(tuple(r) for r in suffix_dedup.dedup(docs, digest=True).collect()) == sorted(want)


def test_interleave_groups_equal_prefixes():
    shards = [sorted([b"abcabcab", b"xabcabc"]), sorted([b"abcabcab", b"cabcabx"])]
    made = [suffix_dedup.transform(s) for s in shards]
    source, block = suffix_dedup.merge(made, 4)
    half, seen = len(made[0][2]), defaultdict(set)
    for place, b in zip(source.tolist(), block.tolist(), strict=True):
        s, at = (0, place) if place < half else (1, place - half)
        _, text, order = made[s]
        start = sum(len(t) + 1 for t in shards[s][: text[order[at]]])
        tail = shards[s][text[order[at]]][order[at] - start :]
        if len(tail) >= 4:
            seen[b].add(tail[:4])
    assert all(len(v) == 1 for v in seen.values())
    assert len({next(iter(v)) for v in seen.values()}) == len(seen)


def test_token_files(docs, ids, empty, monkeypatch):
    monkeypatch.setattr(token_files, "RANGE_BYTES", 3000)
    monkeypatch.setattr(token_files, "FILE_IDS", 500)
    monkeypatch.setattr(token_files, "CHUNK_IDS", 64)
    got = sorted(token_files.digest(token_files.round_trip(docs)).collect())
    start = 0
    for (k, own), r in zip(ids, got, strict=True):
        assert tuple(r) == (k, start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    assert token_files.round_trip(empty).count() == 0


def test_planes_round_trip():
    for n in (0, 1, 7, 1000):
        x = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
        assert (token_files.unplanes(token_files.planes(x), n) == x).all()


def test_packing(docs, ids, empty):
    got = packing.packed(docs).collect()
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        parts[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for k, own in ids:
        for a in range(0, len(own), 4096):
            want[k].append((a, len(own[a : a + 4096]), zlib.crc32(own[a : a + 4096].tobytes()), len(own)))
    assert {k: sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in v) for k, v in parts.items()} == {k: sorted(v) for k, v in want.items()}
    for spots in sequences.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.packed(empty).count() == 0


def test_packing_plan_places_every_piece():
    histogram = {5: 7, 4: 3, 3: 11, 1: 20, 8: 2}
    patterns = packing.plan(histogram, 8)
    placed = defaultdict(int)
    for pattern, n in patterns:
        assert sum(pattern) <= 8
        for size in pattern:
            placed[size] += n
    assert placed == histogram
    assert packing.plan({}, 8) == []


def test_fingerprints(docs, plain, empty, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 3000)
    got = fingerprints.compare(docs).collect()
    order = sorted(((k, t) for k, t, _ in plain), reverse=True)
    want = []
    for i, (k, t) in enumerate(order):
        n = len(t) // 3
        want.append((k, len(t), hashlib.sha256((t[: len(t) - n] + order[(i + 1) % len(order)][1][:n]).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    prints = defaultdict(set)
    texts = {k: t for k, t, _ in plain}
    for r in got:
        prints[texts[r.doc_id]].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in prints.values())
    assert fingerprints.compare(empty).count() == 0


def test_token_counts(docs, plain, empty, library):
    got = sorted(token_counts.thirds(docs).collect())
    for (k, t, _), r in zip(plain, got, strict=True):
        n, counts = len(t), [0, 0, 0]
        for a, z in library.encode(t, add_special_tokens=False).offsets:
            share = [max(0, min(z, n * (j + 1) // 3) - max(a, n * j // 3)) for j in range(3)]
            counts[share.index(max(share))] += 1
        assert (r.doc_id, r.n_tokens, r.head_tokens, r.middle_tokens, r.tail_tokens) == (k, sum(counts), *counts)
    assert token_counts.thirds(empty).count() == 0


def _components(plain):
    sets = []
    for k, t, _ in plain:
        w = t.encode().lower().split()
        sets.append((k, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    label = {k: k for k, _ in sets}
    changed = True
    while changed:
        changed = False
        for a, x in sets:
            for b, y in sets:
                if x and y and 100 * len(x & y) >= 80 * len(x | y) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return sorted((k, len(x), label[k]) for k, x in sets)


@pytest.mark.parametrize("hot", [64, 2])
def test_ngram_join(docs, plain, empty, monkeypatch, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect())
    assert got == _components(plain)
    if hot == 2:
        assert ngram_join.join(empty).count() == 0
        kept = ngram_join.keep_one(docs)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in got})


def test_ngram_join_multiplies_mixed_stars(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base), None)]
    for k in range(1, 40):
        own = list(base)
        for at in rng.choice(120, int(rng.integers(1, 7)), replace=False):
            own[at] = f"x{k}" if k % 3 else f"y{at}"
        rows.append((k, " ".join(own), None))
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == _components(rows)
