"""Token-id files: bit-plane shuffling, zstandard for each plane, a chunk index.

Texts are encoded where they are scanned; only ids travel from there, two bytes each where the vocabulary allows it. They
are stored once, so that finding the key ranges does not encode again, and range-sorted by key.

A file holds the ids of consecutive documents in ascending key order. Ids are cut into chunks of ``CHUNK_IDS``; a chunk's
32-bit integers are transposed into byte planes (all lowest bytes first), every plane is compressed on its own, and a
plane that holds one value only is stored as that value. The index at the end has the offset and id count of each chunk
and the key and id count of each document, so a reader can go to any document without the chunks before it.

Layout: ``MAGIC``, the chunks (for each plane a little-endian length and the bytes), the zstandard-compressed index, its
length as 8 bytes, ``MAGIC``. Files travel as (file number, bytes) rows of a Parquet dataset in the shared folder, which
commits them once a task has finished; a lost executor's part is written again by the retried task.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import batch, released, text_chunks
from .common import drop_dir, parts, shared_dir
from .tokens import task_encoder

MAGIC = b"TOKPLANE"
CHUNK_IDS = 65_536
#: Ids that one stored file holds, about; a longer document has a file of its own.
FILE_IDS = 4_000_000
#: Bytes of ids that one range of the sort holds, about.
RANGE_BYTES = 16 << 20
#: Files up to which the table of their places (some 40 bytes each) is broadcast; beyond, it is joined.
PLACED_FILES = 500_000
#: Ranges whose places are summed up in one task.
TOGETHER = 1024


def planes(ids: np.ndarray) -> bytes:
    """One chunk: each byte plane as a length and compressed bytes."""
    out = []
    for plane in np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T):
        flat = len(plane) and (plane == plane[0]).all()
        raw = b"\0" + bytes(plane[:1]) if flat else b"\1" + zstandard.ZstdCompressor(level=3).compress(plane.tobytes())
        out += [struct.pack("<I", len(raw)), raw]
    return b"".join(out)


def unplanes(raw: bytes, n: int) -> np.ndarray:
    out, at = np.empty((4, n), np.uint8), 0
    for plane in out:
        (size,) = struct.unpack_from("<I", raw, at)
        body = raw[at + 4 : at + 4 + size]
        at += 4 + size
        plane[:] = body[1] if body[:1] == b"\0" else np.frombuffer(zstandard.ZstdDecompressor().decompress(body[1:], max_output_size=n), np.uint8)
    return np.ascontiguousarray(out.T).view("<u4").ravel()


def write(keys: list[int], ids: list[np.ndarray]) -> bytes:
    """A file of the documents in the given order."""
    whole = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    out, offsets, at = [MAGIC], [], len(MAGIC)
    for a in range(0, len(whole), CHUNK_IDS):
        raw = planes(whole[a : a + CHUNK_IDS])
        offsets.append(at)
        out.append(raw)
        at += len(raw)
    index = np.concatenate(
        [[len(offsets), len(keys)], offsets, keys, [len(x) for x in ids]]
    ).astype("<i8").tobytes()
    packed = zstandard.ZstdCompressor().compress(index)
    return b"".join([*out, packed, struct.pack("<Q", len(packed)), MAGIC])


def read(raw: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """The documents of a file: key and ids."""
    assert raw[:8] == MAGIC and raw[-8:] == MAGIC, "not a token file"
    (size,) = struct.unpack("<Q", raw[-16:-8])
    end = len(raw) - 16 - size
    index = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[end : end + size]), "<i8")
    chunks, docs = int(index[0]), int(index[1])
    offsets, keys, counts = np.split(index[2:], [chunks, chunks + docs])
    total, ready, at = int(counts.sum()), np.zeros(0, np.uint32), 0
    starts = np.r_[offsets, end]
    for key, count in zip(keys, counts, strict=True):
        held = [ready]
        have = len(ready)
        while have < count:
            more = unplanes(raw[starts[at] : starts[at + 1]], min(CHUNK_IDS, total - at * CHUNK_IDS))
            held.append(more)
            have += len(more)
            at += 1
        whole = np.concatenate(held)
        yield int(key), whole[:count]
        ready = whole[count:]


_FILE_SQL = "range int, file int, first long, n_ids long, raw binary"
_FILE = [("range", pa.int32()), ("file", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("raw", pa.binary())]


_IDS_SQL = "key long, tie long, wide boolean, ids binary"
_IDS = [("key", pa.int64()), ("tie", pa.int64()), ("wide", pa.bool_()), ("ids", pa.binary())]


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Key, a hash of the text, and the ids of each row: four bytes each if ``wide``, else two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_encoder(tokenizer) as own:
            for part, texts in text_chunks(batches):
                ids = own.encode(texts)
                wide = [len(x) > 0 and int(x.max()) > 0xFFFF for x in ids]
                blobs = [x.astype("<u4" if w else "<u2").tobytes() for x, w in zip(ids, wide, strict=True)]
                yield batch(_IDS, [part.column(0), part.column(1), wide, blobs])

    slim = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("key"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
    return slim.mapInArrow(released(run), _IDS_SQL)


def save(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> None:
    """Writes the ids of all documents to ``folder``, in ascending key order over the files.

    Null texts are empty and give the end id alone; null keys are refused by the index and stored as the smallest key;
    equal keys are ordered by a hash of their text, so one key's rows may lie in several ranges; repeated rows are written as
    often as they come. An empty table writes an empty dataset. Extra columns do not matter.
    """
    spark, stored = docs.sparkSession, f"{folder}-ids"
    encoded(docs, key, text, tokenizer).write.parquet(stored)
    rows = spark.read.schema(_IDS_SQL).parquet(stored)
    n = parts(spark, (rows.agg(F.sum(F.octet_length("ids"))).first()[0] or 0), RANGE_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, number, keys, ids, held = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            return batch(_FILE, [[at], [number], [keys[0]], [held], [write(keys, ids)]])

        for part in batches:
            for k, wide, raw in zip(*(part.column(c).to_pylist() for c in ("key", "wide", "ids")), strict=True):
                own = np.frombuffer(raw, "<u4" if wide else "<u2")
                if held and held + len(own) > FILE_IDS:
                    yield flush()
                    number, keys, ids, held = number + 1, [], [], 0
                keys.append(k)
                ids.append(own)
                held += len(own)
        if keys:
            yield flush()

    # the stored rows come in the same order on every try, so their places may split equal rows
    order = ("key", "tie", "place")
    ranged = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged.mapInArrow(released(run), _FILE_SQL).write.option("compression", "none").parquet(folder)
    drop_dir(spark, stored)


def load(spark, folder: str) -> DataFrame:
    """The documents of the files in ``folder``: doc_id, start (ids before it in the whole), n_tokens, ids (binary, 4 bytes each)."""
    files = spark.read.schema(_FILE_SQL).parquet(folder)
    sizes = files.select("range", "file", "n_ids").withColumn("group", F.expr(f"range div {TOGETHER}"))
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # ranges ascend with the keys: places inside a group of ranges, and one row for each group
    inside = sizes.withColumn("inside", F.sum("n_ids").over(up_to(Window.partitionBy("group").orderBy("range", "file"))) - F.col("n_ids"))
    groups = sizes.groupBy("group").agg(F.sum("n_ids").alias("all"))
    groups = groups.select("group", (F.sum("all").over(up_to(Window.orderBy("group"))) - F.col("all")).alias("ahead"))
    places = inside.join(groups, "group").select("range", "file", (F.col("inside") + F.col("ahead")).alias("before"))
    small = files.count() <= PLACED_FILES
    placed = files.select("range", "file", "raw").join(F.broadcast(places) if small else places, ["range", "file"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for raw, start in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                keys, starts, counts, blobs, held = [], [], [], [], 0
                for key, ids in read(raw.as_py()):
                    keys.append(key)
                    starts.append(start)
                    counts.append(len(ids))
                    blobs.append(ids.astype("<u4").tobytes())
                    start += len(ids)
                    held += len(ids)
                    if held > 1_000_000:
                        yield batch(_DOC, [keys, starts, counts, blobs])
                        keys, starts, counts, blobs, held = [], [], [], [], 0
                if keys:
                    yield batch(_DOC, [keys, starts, counts, blobs])

    return placed.select("raw", "before").mapInArrow(released(run), "doc_id long, start long, n_tokens long, ids binary")


_DOC = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]


def round_trip(docs: DataFrame, **how) -> DataFrame:
    """Saves the documents to a fresh shared folder and reads them back."""
    folder = shared_dir(docs.sparkSession, "token-files")
    save(docs, folder, **how)
    return load(docs.sparkSession, folder)


def digest(loaded: DataFrame) -> DataFrame:
    return loaded.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


__all__ = ["digest", "encoded", "load", "planes", "read", "round_trip", "save", "unplanes", "write"]
