"""Removal of repeated byte strings by merging shard Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes over it also starts in a document with a smaller key. In order:

1. Documents are dealt into row blocks. Each window of ``LENGTH`` bytes is owned by its anchor, the least hash among its
   ``GRAM``-byte grams (the leftmost of equals). Equal windows have equal anchors, wherever they lie.
2. Column blocks of anchor hashes find the anchors of more than one document. A block of documents sends each hash once, and
   knows those that it has twice itself, so a very common hash costs a column one entry for each row block.
3. The stretch of windows that a shared anchor owns (their bytes, at most ``2 * LENGTH - GRAM``) goes to the anchor's column,
   each distinct stretch once for each row block, with its first document there. An anchor with more than ``HOT`` different
   stretches is hot: its windows go one by one to the columns of their own hashes, so no column gathers it.
4. A column keeps each stretch once, with its first document. An anchor of one stretch is settled by that: all its windows
   start in the first document. The others are dealt into shards, and each shard is sorted and transformed on its own.
5. The shards' transforms are merged. The interleave names, for each place in the merged order, the shard suffix that lies
   there. One refinement step stably sorts it by the symbols before the suffixes and follows each suffix to the one that
   these symbols start; after steps of ``LENGTH`` bytes altogether it is right for prefixes of that length, and the places
   where prefixes part (the common prefixes' lengths) have come out as its block bounds. Suffixes are not sorted again.
   Each block is a repeated interval, with the first document over its members. A symbol here is up to ``STEP`` bytes.
6. Row blocks get back which windows of a stretch start in an earlier document; later documents of the same row block with
   the same stretch lose all its windows. Runs of lost bytes are cut out.

Strings are compared whole in steps 4 and 5; hashes only choose where to look, and a false meeting of hashes changes nothing.

Defined cases: null and empty texts have no bytes and keep the hash of nothing; texts shorter than ``LENGTH`` lose nothing;
matches never cross documents; rows with equal keys remove nothing from each other and all stay; a null key counts as
the smallest and is null again in the result; an empty table gives an empty result. Extra columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import arrays, runs
from .common import parts
from .ngram_join import pack, unpack

LENGTH = 50
GRAM = 24
#: Bytes of text in a row block, and bytes of text for each column block, about.
BLOCK_BYTES = 12 << 20
COLUMN_BYTES = 8 << 20
#: Different stretches from which an anchor is hot.
HOT = 20_000
#: Bytes of stretches that are merged at once, about, in so many shards, and bytes of a symbol in the merge.
MERGE_BYTES = 256 << 10
SHARDS = 8
STEP = 16
NO_KEY = -(2**63)
#: Windows that one step of the hashing holds; it fits a core's own cache.
_PIECE = 1 << 15
_TABLE = np.random.default_rng(50).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_NEVER = np.iinfo(np.int64).max


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, _PIECE + 2 * LENGTH)
_DOWN = _powers(pow(_BASE, -1, 2**64), _PIECE + 2 * LENGTH)


def _least(values: np.ndarray, size: int) -> np.ndarray:
    done = 1
    while done < size:
        step = min(done, size - done)
        values = np.minimum(values[: len(values) - step], values[step:])
        done += step
    return values


def stretches(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of joined texts that end at ``ends``: anchor hash, first window, window count, document, hash of the bytes."""
    out = [[np.zeros(0, t)] for t in (np.uint64, np.int64, np.int64, np.int64, np.uint64)]
    place = np.arange(_PIECE + LENGTH, dtype=np.uint64)
    sums = np.zeros(_PIECE + LENGTH, np.uint64)
    heads = np.r_[0, ends[:-1]] if len(ends) else ends
    for start in range(0, max(len(data) - LENGTH + 1, 0), _PIECE):
        # a string's hash is a difference of a running polynomial
        piece = data[start : start + _PIECE + LENGTH - 1]
        np.cumsum(_TABLE[piece] * _UP[: len(piece)], out=sums[1 : len(piece) + 1])
        h = (sums[GRAM : len(piece) + 1] - sums[: len(piece) + 1 - GRAM]) * _DOWN[: len(piece) - GRAM + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        owner = _least((h & np.uint64(0xFFFFFFFFFF000000)) | place[: len(h)], LENGTH - GRAM + 1)
        first, count = runs(owner)
        anchor = (owner[first] & np.uint64(0xFFFFFF)).astype(np.int64)
        # windows over a text's end are none: what stays lies in the text that holds the anchor
        doc = np.searchsorted(ends, anchor + start, side="right")
        last = np.minimum(first + count, ends[doc] - start - LENGTH + 1)
        first = np.maximum(first, heads[doc] - start)
        good = np.flatnonzero((last > first) & (anchor + start + GRAM <= ends[doc]))
        first, count, doc = first[good], last[good] - first[good], doc[good]
        whole = (sums[first + count + LENGTH - 1] - sums[first]) * _DOWN[first] + count.astype(np.uint64)
        for column, part in zip(out, (h[anchor[good]] & np.uint64(0xFFFFFFFFFFFF), first + start, count, doc, whole), strict=True):
            column.append(part)
    return tuple(np.concatenate(x) for x in out)


def _alike(data: np.ndarray, first: np.ndarray, size: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of equal strings of a buffer, and the first place of each code. ``content`` is a hash, the bytes decide."""
    _, at, code = np.unique(content, return_index=True, return_inverse=True)
    again = np.flatnonzero(at[code] != np.arange(len(code)))
    for some in np.array_split(again, len(again) // 50_000 + 1):
        like = at[code[some]]
        if (size[some] != size[like]).any() or (data[_spread(first[some], size[some])] != data[_spread(first[like], size[like])]).any():
            break
    else:
        return code, at
    raw, codes = data.tobytes(), {}
    spans = zip(first.tolist(), (first + size).tolist(), strict=True)
    code = np.array([codes.setdefault(raw[a:b], len(codes)) for a, b in spans], np.int64)
    return code, np.unique(code, return_index=True)[1]


class _Block:
    """The documents of a row block in key order, with their stretches."""

    def __init__(self, table: pa.Table):
        keys = table["key"].to_pylist()
        texts = [b"" if t is None else t for t in table["text"].cast(pa.large_binary()).to_pylist()]
        order = sorted(range(len(keys)), key=lambda i: (keys[i], texts[i]))
        self.keys = np.array([keys[i] for i in order], np.int64)
        self.ends = np.cumsum([len(texts[i]) for i in order])
        self.raw = b"".join([texts[i] for i in order])
        self.data = np.frombuffer(self.raw, np.uint8)
        self.hash, self.first, self.count, self.doc, self.content = stretches(self.data, self.ends)
        self.unique, self.inverse = np.unique(self.hash, return_inverse=True)

    def by_column(self, columns: int) -> Iterator[tuple[int, np.ndarray]]:
        """Places of the unique hashes of each column, ascending."""
        yield from _dealt((self.unique % np.uint64(columns)).astype(np.int64))

    def kinds(self) -> np.ndarray:
        """How many different stretches each hash has here."""
        n = np.bincount(self.inverse, minlength=len(self.unique))
        some = np.flatnonzero((n > 1)[self.inverse])
        some = some[np.lexsort((self.content[some], self.inverse[some]))]
        code, content = self.inverse[some], self.content[some]
        n -= np.bincount(code[1:][(code[1:] == code[:-1]) & (content[1:] == content[:-1])], minlength=len(n))
        return n

    def answered(self, replies: pa.Table, columns: int) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are those of more than one document, and which of these are hot."""
        low, high = np.full(len(self.unique), len(self.keys)), np.zeros(len(self.unique), np.int64)
        np.minimum.at(low, self.inverse, self.doc)
        np.maximum.at(high, self.inverse, self.doc)
        shared, hot = low < high, np.zeros(len(self.unique), bool)
        bits = dict(zip(replies["bucket"].to_pylist(), replies["bits"].to_pylist(), strict=True))
        for column, at in self.by_column(columns):
            both = np.unpackbits(np.frombuffer(bits[column], np.uint8), count=2 * len(at)).astype(bool)
            shared[at] |= both[: len(at)]
            hot[at] = both[len(at) :]
        return shared, shared & hot

    def pieces(self, replies: pa.Table, columns: int) -> _Pieces:
        """The shared stretches, those of hot hashes window by window."""
        shared, hot = (x[self.inverse] for x in self.answered(replies, columns))
        at, alone = np.flatnonzero(shared & ~hot), np.flatnonzero(hot)
        single = _spread(self.first[alone], self.count[alone])
        own = _whole(self.data, single, np.full(len(single), LENGTH))
        first = np.concatenate([self.first[at], single])
        count = np.concatenate([self.count[at], np.ones(len(single), np.int64)])
        doc = np.concatenate([self.doc[at], np.repeat(self.doc[alone], self.count[alone])])
        hashes = np.concatenate([self.hash[at], own & np.uint64(0xFFFFFFFFFFFF)])
        content = np.concatenate([self.content[at], own])
        order = np.argsort(first, kind="stable")
        return _Pieces(self.data, first[order], count[order], doc[order], hashes[order], content[order], columns)


class _Pieces:
    """Stretches of a row block in document order, equal ones under one code, with each code's first stretch."""

    def __init__(self, data: np.ndarray, first: np.ndarray, count: np.ndarray, doc: np.ndarray, hashes: np.ndarray, content: np.ndarray, columns: int):
        self.first, self.count, self.doc = first, count, doc
        self.code, self.at = _alike(data, first, count + LENGTH - 1, content)
        self.hashes = hashes[self.at]
        self.column = (self.hashes % np.uint64(columns)).astype(np.int64)

    def by_column(self) -> Iterator[tuple[int, np.ndarray]]:
        yield from _dealt(self.column)


def _dealt(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(key, kind="stable")
    starts, lengths = runs(key[order])
    for s, n in zip(starts, lengths, strict=True):
        yield int(key[order[s]]), order[s : s + n]


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places ``first``, ``first + 1`` and so on of each run."""
    before = np.cumsum(count) - count
    return np.repeat(first - before, count) + np.arange(int(count.sum()))


def _whole(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of short strings at some places of a buffer."""
    out = np.zeros(len(first), np.uint64)
    for some in np.array_split(np.arange(len(first)), len(first) // 50_000 + 1):
        if len(some):
            n, starts = size[some], np.cumsum(size[some]) - size[some]
            codes = _TABLE[data[_spread(first[some], n)]] * _UP[_spread(np.zeros(len(n), np.int64), n)]
            out[some] = np.add.reduceat(codes, starts) + n.astype(np.uint64)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(32))


def _order(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of integers below ``2**bits``, and the integers in it."""
    room = max(len(key).bit_length(), 1)
    if bits + room > 63:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    packed = (key << room) | np.arange(len(key))
    packed.sort()
    return packed & ((1 << room) - 1), packed >> room


def _dense(key: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """Ranks of integers below ``2**bits`` among the different ones, and how many there are."""
    order, ranked = _order(key, bits)
    rank, named = np.empty(len(key), np.int32), np.cumsum(np.r_[False, ranked[1:] != ranked[:-1]], dtype=np.int32)
    rank[order] = named
    return rank, int(named[-1]) + 1


def transform(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order of sorted texts, each with an end mark: (symbols, text of each place, places in suffix order).

    Symbols are bytes plus one, the end mark 0; equal suffixes are in text order, so rotations of sorted texts are in order too.
    """
    lens = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lens + 1) - 1
    symbols = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
    symbols[ends] = 0
    text = np.repeat(np.arange(len(texts)), lens + 1)
    n = len(symbols)
    left = ends[text] - np.arange(n)
    padded = np.r_[symbols, np.zeros(8, np.int64)]
    key = np.zeros(n, np.int64)
    for k in range(4):
        key = (key << 9) | np.where(left >= k, padded[k : k + n], 0)
    width, longest, known, bits = 4, int(lens.max()) + 1, 0, 36
    while True:
        rank, found = _dense(key, bits)
        if width >= longest or found == known:
            break
        half = found.bit_length() + 1
        after = np.zeros(n, np.int64)
        after[: max(n - width, 0)] = rank[width:]
        after[: max(n - width, 0)] += 1
        key = (rank.astype(np.int64) << half) | np.where(left >= width, after, 0)
        width, known, bits = 2 * width, found, 2 * half
    room = len(texts).bit_length()
    return symbols, text, _order((rank.astype(np.int64) << room) | text, found.bit_length() + room)[0]


def _steps(length: int) -> list[int]:
    """Sizes of the refinement steps: whole symbols, then halves of what is left."""
    out, step = [], STEP
    while length:
        out += [step] * (length // step)
        length, step = length % step, step // 2
    return out


def merge(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Interleaves sorted shards: (place of each merged suffix in the shards' orders, joined; block of equal ``length``-prefixes).

    A shard is (symbols, text of each place, places in suffix order) as ``transform`` gives them.
    """
    steps = _steps(length)
    before, follow, base = [], [], 0
    for symbols, text, order in shards:
        ends = np.r_[np.flatnonzero(np.diff(text)), len(text) - 1]
        starts = np.r_[0, ends[:-1] + 1]
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(base, base + len(order), dtype=np.int32)
        # the symbol before each suffix, and where the suffix lies that it starts; texts are round
        ahead = order - 1
        round_ = np.flatnonzero(order == starts[text[order]])
        ahead[round_] = ends[text[order[round_]]]
        before.append(symbols[ahead])
        follow.append(place[ahead])
        base += len(order)
    before, follow, n = {1: np.concatenate(before)}, {1: np.concatenate(follow)}, {1: 257}
    k = 1
    while k < max(steps):
        # twice the symbols: those further ahead, then the nearer ones
        bits = n[k].bit_length()
        before[2 * k], n[2 * k] = _dense((before[k][follow[k]].astype(np.int64) << bits) | before[k], 2 * bits)
        follow[2 * k] = follow[k][follow[k]]
        k *= 2
    source = np.arange(base, dtype=np.int32)
    block = np.zeros(base, np.int32)
    for k in steps:
        order, symbol = _order(before[k][source].astype(np.int64), n[k].bit_length())
        block, source = block[order], follow[k][source[order]]
        block = np.cumsum(np.r_[False, (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])], dtype=np.int32)
    return source, block


def first_keys(shards: list[tuple[list[bytes], np.ndarray]]) -> list[np.ndarray]:
    """For each shard (sorted texts, keys): the least key that has the window, for all windows of its texts one after another."""
    made = [transform(texts) for texts, _ in shards]
    source, block = merge(made)
    key, window = [], []
    for (texts, keys), (_, text, order) in zip(shards, made, strict=True):
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        key.append(keys[text[order]])
        window.append(order + LENGTH <= ends[text[order]])
    key, window = np.concatenate(key)[source], np.concatenate(window)[source]
    first, count = runs(block)
    merged = np.empty(len(source), np.int64)
    merged[source] = np.repeat(np.minimum.reduceat(np.where(window, key, _NEVER), first), count)
    out, base = [], 0
    for texts, (_, text, order) in zip((s[0] for s in shards), made, strict=True):
        least = np.empty(len(order), np.int64)
        least[order] = merged[base : base + len(order)]
        lens = np.array([len(t) for t in texts], np.int64)
        out.append(least[_spread(np.cumsum(lens + 1) - lens - 1, lens - LENGTH + 1)])
        base += len(order)
    return out


def settle(data: np.ndarray, size: np.ndarray, keys: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """For joined stretches of so many bytes with their first keys: which windows, one after another, also start under a smaller key."""
    first = np.cumsum(size) - size
    code, at = _alike(data, first, size, _whole(data, first, size))
    least = np.full(len(at), _NEVER)
    np.minimum.at(least, code, keys)
    _, group, members = np.unique(anchors[at], return_inverse=True, return_counts=True)
    several = np.flatnonzero(members[group] > 1)
    windows = size[at] - LENGTH + 1
    starts = np.cumsum(windows) - windows
    known = np.repeat(least, windows)
    # an anchor's stretches are merged together, different anchors have no window in common
    several = several[np.argsort(group[several], kind="stable")]
    held = np.cumsum(size[at[several]])
    new = np.r_[True, group[several][1:] != group[several][:-1]] if len(several) else np.zeros(0, bool)
    heap = np.maximum.accumulate(np.where(new, held // MERGE_BYTES, 0))
    raw = data.tobytes()
    for s, n in zip(*runs(heap), strict=True):
        shards = []
        for some in np.array_split(several[s : s + n], SHARDS):
            texts = [raw[a:b] for a, b in zip(first[at[some]].tolist(), (first + size)[at[some]].tolist(), strict=True)]
            order = sorted(range(len(texts)), key=texts.__getitem__)
            if order:
                shards.append(([texts[i] for i in order], some[order]))
        for (_, some), own in zip(shards, first_keys([(t, least[some]) for t, some in shards]), strict=True):
            known[_spread(starts[some], windows[some])] = own
    return known[_spread(starts[code], windows[code])] < np.repeat(keys, windows[code])


def _result(block: _Block, cut: _Pieces, masks: dict[int, np.ndarray]) -> Iterator[tuple]:
    """Cuts the lost windows out of the block's documents."""
    size = cut.count[cut.at]
    base, lost, at = np.zeros(len(size), np.int64), [np.zeros(0, bool)], 0
    for column, own in cut.by_column():
        total = int(size[own].sum())
        base[own] = at + np.cumsum(size[own]) - size[own]
        lost.append(np.unpackbits(np.frombuffer(masks[column], np.uint8), count=total).astype(bool))
        at += total
    lost = np.concatenate(lost)
    so_far = np.r_[0, np.cumsum(lost)]
    n_lost = so_far[base + size] - so_far[base]
    whole = (block.keys[cut.doc] > block.keys[cut.doc[cut.at]][cut.code]) | (n_lost == size)[cut.code]
    part = np.flatnonzero(~whole & (n_lost > 0)[cut.code])
    edges = np.zeros(len(block.data) + 1, np.int32)
    np.add.at(edges, cut.first[whole], 1)
    np.add.at(edges, cut.first[whole] + cut.count[whole], -1)
    first = np.cumsum(edges[:-1]) > 0
    first[_spread(cut.first[part], cut.count[part])[lost[_spread(base[cut.code[part]], cut.count[part])]]] = True
    running = np.cumsum(first, dtype=np.int32)
    gone = running > 0
    gone[LENGTH:] = running[LENGTH:] > running[:-LENGTH]
    rises = gone & ~np.r_[False, gone[:-1]] if len(gone) else gone
    starts = np.r_[0, block.ends[:-1]] if len(block.ends) else block.ends
    some = starts < block.ends
    rises[starts[some]] = gone[starts[some]]
    removed, spans = (np.diff(np.searchsorted(np.flatnonzero(x), [*starts, len(gone)])).tolist() for x in (gone, rises))
    for key, a, b, n, m in zip(block.keys.tolist(), starts.tolist(), block.ends.tolist(), removed, spans, strict=True):
        kept = block.data[a:b][~gone[a:b]].tobytes() if n else block.raw[a:b]
        yield (None if key == NO_KEY else key, b - a, n, m, kept)


_SENT = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("kinds", pa.binary())])
_BITS = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())])
_SHARD = pa.schema([
    ("block", pa.int32()), ("bucket", pa.int32()), ("lens", pa.binary()), ("raw", pa.binary()), ("keys", pa.binary()), ("anchors", pa.binary()),
])
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
_SQL = {
    "sent": "block int, bucket int, hashes binary, kinds binary", "bits": "block int, bucket int, bits binary",
    "shard": "block int, bucket int, lens binary, raw binary, keys binary, anchors binary",
    "digest": "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
    "kept": "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary",
}


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, and kept (bytes) or, with ``digest``, kept_sha256."""
    slim = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"), F.col(text).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows, columns = parts(docs.sparkSession, size, BLOCK_BYTES), parts(docs.sparkSession, size, COLUMN_BYTES)
    dealt = slim.withColumn("block", F.pmod(F.xxhash64("key", "text"), F.lit(rows)).cast("int")).repartition(rows, "block")

    def send(table: pa.Table) -> pa.Table:
        block = _Block(table)
        at, kinds = table["block"][0].as_py(), np.minimum(block.kinds(), 2**32 - 1).astype("<u4")
        return _table([(at, c, pack(block.unique[p]), kinds[p].tobytes()) for c, p in block.by_column(columns)], _SENT)

    def count(table: pa.Table) -> pa.Table:
        hashes = [unpack(v) for v in table["hashes"].to_pylist()]
        _, code, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        kinds = np.bincount(code, weights=np.concatenate(arrays(table["kinds"], "<u4")))
        shared, hot = (times > 1)[code], (kinds > HOT)[code]
        edges = np.cumsum([0, *(len(h) for h in hashes)])
        both = [np.packbits(np.r_[shared[a:b], hot[a:b]]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return _table(list(zip(table["block"].to_pylist(), table["bucket"].to_pylist(), both, strict=True)), _BITS)

    def shards(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([], _SHARD)
        block = _Block(table)
        cut = block.pieces(replies, columns)
        at, first = table["block"][0].as_py(), block.keys[cut.doc[cut.at]]
        first_of, size = cut.first[cut.at], cut.count[cut.at] + LENGTH - 1
        out = []
        for column, own in cut.by_column():
            raw = block.data[_spread(first_of[own], size[own])].tobytes()
            out.append((at, column, size[own].astype("<u1").tobytes(), raw, first[own].tobytes(), pack(cut.hashes[own])))
        return _table(out, _SHARD)

    def interleave(table: pa.Table) -> pa.Table:
        sizes = [x.astype(np.int64) for x in arrays(table["lens"], "<u1")]
        anchors = np.concatenate([unpack(v) for v in table["anchors"].to_pylist()])
        data = np.frombuffer(b"".join(table["raw"].to_pylist()), np.uint8)
        lost = settle(data, np.concatenate(sizes), np.concatenate(arrays(table["keys"], "<i8")), anchors)
        edges = np.cumsum([0, *(int(x.sum()) - len(x) * (LENGTH - 1) for x in sizes)])
        bits = [np.packbits(lost[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return _table(list(zip(table["block"].to_pylist(), table["bucket"].to_pylist(), bits, strict=True)), _BITS)

    def finish(table: pa.Table, replies: pa.Table, masks: pa.Table) -> pa.Table:
        block = _Block(table)
        own = dict(zip(masks["bucket"].to_pylist(), masks["bits"].to_pylist(), strict=True))
        cut = list(_result(block, block.pieces(replies, columns), own))
        if digest:
            cut = [(*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in cut]
            return _table(cut, pa.schema([*list(_KEPT)[:4], ("kept_sha256", pa.string())]))
        return _table(cut, _KEPT)

    def both(table: pa.Table, answers: pa.Table) -> pa.Table:
        """Answers of both kinds come with their kind."""
        if not table.num_rows:
            return _table([], pa.schema([*list(_KEPT)[:4], ("kept_sha256", pa.string())]) if digest else _KEPT)
        first = np.array(answers["kind"].to_pylist(), dtype=np.int64) == 0
        return finish(table, answers.filter(pa.array(first)), answers.filter(pa.array(~first)))

    sent = dealt.groupBy("block").applyInArrow(send, _SQL["sent"])
    replies = sent.repartition(columns, "bucket").groupBy("bucket").applyInArrow(count, _SQL["bits"]).repartition(rows, "block")
    cut = dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(shards, _SQL["shard"])
    masks = cut.repartition(columns, "bucket").groupBy("bucket").applyInArrow(interleave, _SQL["bits"])
    answers = replies.withColumn("kind", F.lit(0)).unionByName(masks.withColumn("kind", F.lit(1))).repartition(rows, "block")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(both, _SQL["digest" if digest else "kept"])


#: Bytes are pairs of hexadecimal digits; windows of equal length make runs by their starts alone.
ORACLE = r"""
with b as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
o as (select doc_id, h, unnest(range(0, len(h) // 2, 512)) as o from b where len(h) >= 100),
q as (select doc_id, o, substr(h, 2 * o + 1, 1122) as h from o),
p as (select doc_id, o, h, unnest(range(0, least(512, len(h) // 2 - 49))) as j from q where len(h) >= 100),
win as (select doc_id, o + j as i, substr(h, 2 * j + 1, 100) as s from p),
early as (select s, min(doc_id) as f from win group by 1),
lost as (select doc_id, i from win join early using (s) where f < doc_id),
marked as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as new from lost),
numbered as (select doc_id, i, sum(new) over (partition by doc_id order by i) as k from marked),
runs as (select doc_id, k, min(i) as a, max(i) + 50 as z from numbered group by 1, 2),
gaps as (select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) as low from runs),
cut as (select doc_id, count(*) as n_spans, sum(z - a)::bigint as n_removed, max(z) as last, string_agg(substr(h, 2 * low + 1, 2 * (a - low)), '' order by a) as kept
        from gaps join b using (doc_id) group by 1)
select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
       sha256(unhex(case when last is null then h else kept || substr(h, 2 * last + 1) end)) as kept_sha256
from b left join cut using (doc_id)
"""
