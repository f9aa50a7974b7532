"""Document fingerprints: improbable byte windows in chained Bloom filters.

Every window of ``WINDOW`` bytes has an entropy, cut into ``LEVELS`` + 1 levels. The levels' counts over the whole corpus
(one fixed-size histogram) say how improbable each level is; that is a window's rank. Among the windows of each run of
``RUN`` places, the most improbable one (the first of equals) is a vote for its place; windows with ``VOTES`` votes or more
are the text's features. Features go, in text order, into a chain of Bloom filters of ``FILTER_BITS`` bits with
``PER_FILTER`` features each. Two fingerprints are compared filter by filter: the overlap of the bits, less what chance
gives, by what full containment would give; each filter of the shorter chain takes its best partner.

A fingerprint is the filters in hexadecimal, joined by colons, each with its feature count. Texts shorter than one window,
or whose windows all have one repeated byte, fall back on one feature, the whole text; the empty text has the empty
fingerprint.

Likeness is 1 for equal fingerprints (also two empty ones), 0 if just one is empty.

Defined cases: null texts count as empty; repeated rows get equal fingerprints; equal keys are ordered by text; an empty
table gives an empty result. Extra columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import CHUNK_BYTES, batch, text_chunks
from .common import below, parts

WINDOW = 32
LEVELS = 1000
RUN = 32
VOTES = 8
FILTER_BITS = 2048
PROBES = 5
PER_FILTER = 160
#: Bytes of text that one range of neighbouring documents holds, about.
RANGE_BYTES = 24 << 20
#: Ranges at most; larger inputs have longer ranges, which stream through a task.
MOST_RANGES = 10_000
#: Bytes of text that are fingerprinted at once.
HELD_BYTES = 2 << 20
#: Stands for a null key: the smallest.
NO_KEY = -(2**63)
#: Bytes that one lane of the rolling entropy goes through.
_LANE = 512
_NLOG = np.arange(WINDOW + 2) * np.log2(np.maximum(np.arange(WINDOW + 2), 1))
_HASH = np.random.default_rng(64).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.array([0x9E3779B97F4A7C15], np.uint64) * np.arange(1, 2 * PROBES, 2, dtype=np.uint64)


def levels(data: np.ndarray) -> np.ndarray:
    """Entropy level of the window at each place of a buffer (at least ``WINDOW`` bytes long).

    All lanes of the buffer move on together, one byte a step, with a byte count for each lane.
    """
    n = len(data) - WINDOW + 1
    lanes = -(-n // _LANE)
    padded = np.zeros(lanes * _LANE + WINDOW, np.uint8)
    padded[: len(data)] = data
    at = np.arange(lanes) * _LANE
    counts = np.zeros((lanes, 256), np.uint8)
    flat, base = counts.ravel(), np.arange(lanes) * 256
    total = np.zeros(lanes)
    out = np.empty((_LANE, lanes), np.float32)
    grow = _NLOG[1:] - _NLOG[:-1]
    for step in range(WINDOW + _LANE - 1):
        cell = base + padded[at + step]
        was = flat[cell]
        total += grow[was]
        flat[cell] = was + 1
        if step >= WINDOW - 1:
            start = step - WINDOW + 1
            out[start] = total
            cell = base + padded[at + start]
            was = flat[cell]
            total -= grow[was - 1]
            flat[cell] = was - 1
    entropy = np.log2(WINDOW) - out.T.ravel()[:n] / WINDOW
    return np.clip(np.rint(entropy * (LEVELS / np.log2(WINDOW))), 0, LEVELS).astype(np.int16)


def _windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buffer of all texts, and the range of window starts of each text."""
    edges = np.r_[0, np.cumsum([len(t) for t in texts])]
    data = np.frombuffer(b"".join(texts) + b"\0" * WINDOW, np.uint8)
    return data, edges[:-1], np.maximum(edges[1:] - WINDOW + 1, edges[:-1])


def histogram(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Windows of each level over all documents; the fixed number of levels is all that reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS + 1, np.int64)
        for _, texts in text_chunks(batches):
            data, low, high = _windows(texts)
            all_levels, inside = levels(data), np.zeros(len(data) + 1, np.int32)
            np.add.at(inside, low, 1)
            np.add.at(inside, high, -1)
            total += np.bincount(all_levels[np.cumsum(inside)[: len(all_levels)] > 0], minlength=LEVELS + 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["level", "n"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "level int, n long").groupBy("level").agg(F.sum("n").alias("n"))
    out = np.zeros(LEVELS + 1, np.int64)
    for row in found.collect():
        out[row.level] = row.n
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each level: 0 for the least common. Levels of hardly any entropy rank last, as they tell nothing apart."""
    order = np.argsort(counts, kind="stable")
    rank = np.empty(len(counts), np.int32)
    rank[order] = np.arange(len(counts))
    rank[: LEVELS // 10] = len(counts)
    return rank


def _running_least(values: np.ndarray, size: int) -> np.ndarray:
    out, done = values, 1
    while done < size:
        step = min(done, size - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def _hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the windows at some places."""
    codes = np.zeros(len(at), np.uint64)
    for k in range(WINDOW):
        codes *= _STEP
        codes += _HASH[data[at + k]]
    return codes ^ (codes >> np.uint64(29))


def features(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """64-bit hashes of each text's selected windows, in text order.

    Texts above ``CHUNK_BYTES`` go piece by piece; pieces overlap by what votes reach over, so cuts change no feature.
    """
    out, short = [np.zeros(0, np.uint64)] * len(texts), []
    for k, t in enumerate(texts):
        if len(t) <= CHUNK_BYTES:
            short.append(k)
            continue
        n, found = len(t) - WINDOW + 1, []
        for a in range(0, n, CHUNK_BYTES):
            low, high = max(0, a - RUN + 1), min(n, a + CHUNK_BYTES + RUN - 1)
            data, (chosen,) = _chosen([t[low : high + WINDOW - 1]], rank)
            chosen = chosen[(chosen + low >= a) & (chosen + low < a + CHUNK_BYTES)]
            found.append(_hashes(data, chosen))
        whole = np.concatenate(found)
        out[k] = whole if len(whole) else _whole(t)
    data, places = _chosen([texts[k] for k in short], rank)
    for k, at in zip(short, places, strict=True):
        out[k] = _hashes(data, at) if len(at) else _whole(texts[k])
    return out


def _chosen(texts: list[bytes], rank: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Buffer of all texts, and the places in it of each text's windows with enough votes."""
    data, low, high = _windows(texts)
    keyed = rank[levels(data)].astype(np.int64)
    out = []
    for a, b in zip(low, high, strict=True):
        own = keyed[a:b]
        if not len(own):
            out.append(np.zeros(0, np.int64))
            continue
        least = _running_least((own << 32) | np.arange(b - a), min(RUN, b - a))
        votes = np.bincount(least & 0xFFFFFFFF, minlength=b - a)
        out.append(a + np.flatnonzero((votes >= min(VOTES, len(least))) & (own <= LEVELS)))
    return data, out


def _whole(text: bytes) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(text, digest_size=8).digest(), "<u8") if text else np.zeros(0, np.uint64)


def chain(hashes: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Bloom filters as (features, bits), each feature that a filter already has is not counted again."""
    out = []
    unique = hashes[np.sort(np.unique(hashes, return_index=True)[1])]
    for a in range(0, len(unique), PER_FILTER):
        own = unique[a : a + PER_FILTER]
        bits = np.zeros(FILTER_BITS, bool)
        for step in _STEPS:
            bits[((own * step) >> np.uint64(64 - 11)).astype(np.int64)] = True
        out.append((len(own), bits))
    return out


def encode(filters: list[tuple[int, np.ndarray]]) -> str:
    return ":".join(f"{n:02x}{np.packbits(bits).tobytes().hex()}" for n, bits in filters)


def decode(fingerprint: str) -> list[tuple[int, np.ndarray]]:
    return [
        (int(p[:2], 16), np.unpackbits(np.frombuffer(bytes.fromhex(p[2:]), np.uint8)).astype(bool))
        for p in fingerprint.split(":")
        if p
    ]


def likeness(a: list[tuple[int, np.ndarray]], b: list[tuple[int, np.ndarray]]) -> float:
    """0 to 1: how far the bits of the shorter chain's filters are found in the other's beyond chance."""
    if not a or not b:
        return float(not a and not b)
    x, y = np.array([f for _, f in a], np.float32), np.array([f for _, f in b], np.float32)
    if x.shape == y.shape and (x == y).all():
        return 1.0
    if len(x) > len(y):
        x, y, a = y, x, b
    nx, ny = x.sum(1)[:, None], y.sum(1)[None, :]
    chance, full = nx * ny / FILTER_BITS, np.minimum(nx, ny)
    share = np.clip((x @ y.T - chance) / np.maximum(full - chance, 1e-9), 0, 1).max(1)
    weight = np.array([n for n, _ in a], float)
    return float((share * weight).sum() / weight.sum())


def edited(own: str, following: str) -> str:
    """The text with its last third replaced by the start of the following one."""
    n = len(own) // 3
    return own[: len(own) - n] + following[:n]


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, int]:
    """(range, own, key, text) rows: each range of keys in one group, and the document that follows its last one.

    Documents run in descending key order, the first of all follows the last. The bounds are quantiles of the keys, at
    most ``MOST_RANGES``; the first document of each range is copied to the range that it follows.
    """
    spark = docs.sparkSession
    slim = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    facts = slim.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).first()
    n = min(MOST_RANGES, parts(spark, facts.bytes or 0, RANGE_BYTES))
    bounds = slim.stat.approxQuantile("key", [i / n for i in range(1, n)], 0.2 / n) if facts.n else []
    placed = slim.withColumn("range", below(F.lit(sorted({int(b) for b in bounds}) or [NO_KEY]), F.col("key")))
    tops = sorted((r.range, r.top) for r in placed.groupBy("range").agg(F.max("key").alias("top")).collect())
    gives = [(top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)]
    table = F.broadcast(spark.createDataFrame(gives, "top long, also int"))
    ways = F.array(
        F.struct(F.col("range").alias("range"), F.lit(True).alias("own")), F.struct(F.col("also").alias("range"), F.lit(False).alias("own"))
    )
    spread = placed.join(table, placed.key == table.top, "left").select("key", "text", F.explode(ways).alias("to"))
    return spread.select("to.range", "to.own", "key", "text").where("range is not null"), n


_OUT_SQL = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)
_OUT = [
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
]


def compare(docs: DataFrame, key: str = "doc_id", text: str = "text", counts: np.ndarray | None = None) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likenesses. ``counts`` is a stored histogram."""
    rank = ranks(histogram(docs, text) if counts is None else counts)
    spread, n = neighbours(docs, key, text)

    def emit(held: list[tuple[int, str]], following: str) -> pa.RecordBatch:
        """Rows for consecutive documents and the text that follows the last."""
        after = [*[t for _, t in held[1:]], following]
        changed = [edited(t, f) for (_, t), f in zip(held, after, strict=True)]
        prints = [chain(h) for h in features([t.encode() for _, t in held] + [following.encode()], rank)]
        others = [chain(h) for h in features([c.encode() for c in changed], rank)]
        rows = [
            (None if k == NO_KEY else k, len(t), hashlib.sha256(c.encode()).hexdigest(), encode(p), encode(e), likeness(p, e), likeness(p, q))
            for (k, t), c, p, e, q in zip(held, changed, prints[:-1], others, prints[1:], strict=True)
        ]
        return batch(_OUT, list(zip(*rows, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part, texts in text_chunks(batches):
            owns, keys = (part.column(part.schema.get_field_index(k)).to_pylist() for k in ("own", "key"))
            for own, k, t in zip(owns, keys, texts, strict=True):
                if held and (not own or size > HELD_BYTES):
                    yield emit(held, t.decode())
                    held, size = [], 0
                if own:
                    held.append((k, t.decode()))
                    size += len(t)

    # a range's own rows in descending order, then the document that follows them
    order = [F.col("range"), F.col("own").desc(), F.col("key").desc(), F.col("text").desc()]
    return spread.repartition(n, "range").sortWithinPartitions(*order).mapInArrow(run, _OUT_SQL)
