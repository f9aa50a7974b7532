"""What workers hold: the shingle steps for each byte and shingle, and the token cache after a task."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from driftloom.llm import blocks, ngram_join, tokens


def _peak(step):
    tracemalloc.start()
    try:
        out = step()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_word_hashes_of_a_long_text():
    raw = b"some word here\n" * 400_000
    (starts, hashes), peak = _peak(lambda: blocks.word_hashes(raw))
    assert len(starts) == 1_200_000 and len(np.unique(hashes)) == 3
    assert peak < 100e6  # 6 MB of text, 19 MB of results


def test_counting_a_column_block():
    n, each = 2000, 500
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 2**47, n * each, dtype=np.uint64)
    hashes[each : 2 * each] = hashes[:each]
    ids = np.arange(n, dtype=np.int64)
    cells = [[0], [-1], [ids.tobytes()], [blocks.mixed(ids.view(np.uint64)).tobytes()], [np.full(n, each, "<u4").tobytes()], [ngram_join.pack(hashes)], [b""], [b""]]
    table = pa.Table.from_batches([blocks.batch(ngram_join._PACKET, cells)])
    out, peak = _peak(lambda: list(ngram_join._count(1, 1)(0, table)))
    assert sum(len(x) for o in out for x in blocks.arrays(o.column(3), "<u8")) >= 2
    found = np.concatenate([ngram_join.unpack(x) for o in out for x in o.column(5).to_pylist()])
    assert set(hashes[:each].tolist()) <= set(found.tolist())
    assert peak < 45 * n * each


def test_the_token_cache_after_a_task(monkeypatch):
    pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(tokens, "KEPT_WORDS", 20)
    texts = [f"The word Number{chr(97 + k % 26)}{chr(97 + k // 26)}, café São{k}! 'tis <|endoftext|> {k}%%".encode() for k in range(300)]
    with tokens.task_encoder() as own:
        first = own.encode(texts)
        assert len(own.known) > 300
    assert len(own.known) == 20 and tokens.encoder(None) is own
    for got, again, text in zip(first, own.encode(texts), texts, strict=True):
        want = [*own.tokenizer.encode(text.decode(), add_special_tokens=False).ids, tokens.END]
        assert got.tolist() == want and again.tolist() == want


def test_known_words_are_only_looked_up():
    pytest.importorskip("public_tokenizers")
    text = " ".join(f"Word{chr(97 + k % 26)}, the café" for k in range(600)).encode()
    own = tokens.WordEncoder()
    want = [*own.tokenizer.encode(text.decode(), add_special_tokens=False).ids, tokens.END]
    own.encode([text])
    out, peak = _peak(lambda: own.encode([text] * 200))
    assert all(x.tolist() == want for x in out)
    assert peak < 4 * len(want) * 200 + 2e6  # the ids and one text's words, not those of all texts, nor a set of them


def test_a_large_column_block_is_counted_in_passes():
    n, each = 4000, 500
    rng = np.random.default_rng(6)
    hashes = rng.integers(0, 2**47, n * each, dtype=np.uint64)
    hashes[each : 2 * each] = hashes[:each]
    ids = np.arange(n, dtype=np.int64)
    cells = [[0, 0], [-1, -2], [ids.tobytes(), b""], [blocks.mixed(ids.view(np.uint64)).tobytes(), b""], [np.full(n, each, "<u4").tobytes(), b""]]
    table = pa.Table.from_batches([blocks.batch(ngram_join._PACKET, [*cells, [ngram_join.pack(hashes), ngram_join.pack(hashes[:3])], [b""] * 2, [b""] * 2])])
    out, peak = _peak(lambda: list(ngram_join._count(1, 1)(0, table)))
    found = np.concatenate([ngram_join.unpack(x) for o in out for x in o.column(5).to_pylist()])
    times = np.concatenate([x for o in out for x in blocks.arrays(o.column(6), "<u4")])
    known, counts = np.unique(hashes, return_counts=True)
    marked = hashes[:3]
    want = [(h, ngram_join._MOST if h in marked else c) for h, c in zip(known, counts, strict=True) if c > 1]
    assert sorted(zip(found, times, strict=True)) == sorted(w for w in want for _ in range(2))
    assert peak < 22 * n * each  # 36 with the whole block sorted at once


def test_packets_of_a_chunk():
    n, each = 1200, 400
    texts = [" ".join(f"w{k}x{j * 7919}" for j in range(each)) for k in range(n)]
    chunk = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts), pa.array([0] * n, pa.int64())], names=["id", "text", "missing"])
    out, peak = _peak(lambda: [o.num_rows for o in ngram_join._packets(17, 17)(iter([chunk]))])
    assert sum(out) > 17
    assert peak < 90 * n * each  # some 124 with every step's arrays held to the end


def test_memory_goes_back_after_a_task():
    def resident():
        with open("/proc/self/smaps_rollup") as f:
            return next(int(line.split()[1]) for line in f if line.startswith("Anonymous:")) << 10

    def run(batches):
        held = [np.ones(60_000, np.uint8) for _ in range(2000)]  # below the size that the C library maps apart
        kept.append(np.ones(60_000, np.uint8))  # lies behind them, so the heap can't shrink from its end
        yield from batches
        del held

    kept = []
    before = resident()
    assert list(blocks.released(run)(iter([1, 2]))) == [1, 2]
    assert resident() - before < 30e6  # of 120


def test_each_block_has_a_task_of_its_own(spark):
    def step(at, table):
        from pyspark import TaskContext

        keys = set(table["key"].to_pylist())
        yield pa.RecordBatch.from_pydict({"at": [int(at)], "task": [TaskContext.get().partitionId()], "n": [table.num_rows], "keys": [len(keys)]})

    rows = spark.range(0, 3000, 1, 5).selectExpr("cast(id % 30 as int) as key", "id")
    got = blocks.grouped(rows.where("key <> 7"), "key", 30, step, "at long, task long, n long, keys long").collect()
    assert sorted(r["at"] for r in got) == [k for k in range(30) if k != 7]
    assert all(r["n"] == 100 and r["keys"] == 1 for r in got)
    assert len({r["task"] for r in got}) == 29
