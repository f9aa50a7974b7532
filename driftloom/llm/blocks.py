"""Arrow plumbing for the operators that run NumPy inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from .common import parts

#: Bytes of text that one step of a map task holds; a longer single text is a step of its own.
CHUNK_BYTES = 4 << 20
#: Bytes of text whose words are hashed together; some forty bytes are held for each.
PIECE_BYTES = 1 << 18


def text_chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most about ``most`` bytes of text, with the texts' bytes (null: empty)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.array([0 if v is None else v for v in pa.compute.binary_length(column).to_pylist()], dtype=np.int64)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield _with_texts(batch.slice(start, i - start), text)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield _with_texts(batch.slice(start), text)


def _with_texts(batch: pa.RecordBatch, text: str) -> tuple[pa.RecordBatch, list[bytes]]:
    column = batch.column(batch.schema.get_field_index(text))
    return batch, [b"" if v is None else v for v in column.cast(pa.large_binary()).to_pylist()]


def release() -> None:
    """Gives what this process has freed back to the system. The C library keeps it otherwise (without glibc, nothing is done there)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run: Callable) -> Callable:
    """``run`` over a task's batches with ``release`` behind it: a worker outlives its tasks, idle beside those of other stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def grouped(df: DataFrame, key: str, n: int, step: Callable, schema: str) -> DataFrame:
    """Runs ``step(key, table)``, a generator of record batches, for each value of ``key``, which are 0 to n - 1.

    Each value has a partition of its own; dealt by a hash, a few would meet in one task and others stay idle. Unlike a grouped map,
    results leave as they are made. Only ``step`` holds its table, so it may give it up on the way.
    """

    def taken(held: list[pa.RecordBatch]) -> pa.Table:
        table = pa.Table.from_batches(held)
        held.clear()
        return table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from step(held[0].column(held[0].schema.get_field_index(key))[0].as_py(), taken(held))

    return df.repartitionById(n, key).mapInArrow(released(run), schema)


def sized(df: DataFrame, units: int, per_part: int) -> int:
    return parts(df.sparkSession, units, per_part)


def arrays(column: pa.ChunkedArray, dtype: str) -> list[np.ndarray]:
    """Binary cells as arrays."""
    return [np.frombuffer(v, dtype=dtype) for v in column.to_pylist()]


def cells(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """Binary cells as bytes, in place."""
    return [np.frombuffer(v.as_buffer(), np.uint8) for v in column]


def batch(schema: list[tuple[str, pa.DataType]], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


def runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, len(ordered)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_TABLE = np.random.default_rng(20_240_229).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x5851F42D4C957F2D)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = _BASE
        np.multiply.accumulate(out, out=out)
    return out


def word_hashes(raw: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words of a buffer, worked off in pieces that end at white space."""
    data, starts, hashes, at = np.frombuffer(raw, np.uint8), [], [], 0
    while at < len(data):
        end = min(len(data), at + PIECE_BYTES)
        while end < len(data) and not _SPACE[data[end]]:
            more = np.flatnonzero(_SPACE[data[end : end + PIECE_BYTES]])
            end = end + int(more[0]) if len(more) else min(len(data), end + PIECE_BYTES)
        piece = data[at:end]
        word = ~_SPACE[piece]
        first = np.flatnonzero(word & ~np.r_[False, word[:-1]])
        if len(first):
            places = np.flatnonzero(word)
            length = np.diff(np.r_[np.searchsorted(places, first), len(places)])
            inside = places - np.repeat(first, length)
            codes = _TABLE[_LOWER[piece[places]] if lower else piece[places]]
            codes *= _powers(int(length.max()))[inside]
            total = np.add.reduceat(codes, np.r_[0, np.cumsum(length)[:-1]])
            starts.append(first + at)
            hashes.append(mixed(total + length.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)
