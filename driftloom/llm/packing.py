"""Packing by shortest-pack-first over the length histogram.

Documents are cut into pieces of at most ``LENGTH`` tokens: whole sequences first, then the remainder. The histogram of
piece lengths has at most ``LENGTH`` bins, whatever the corpus. ``plan`` goes through it from the longest length down and
puts pieces of that length into the open packs with the most room that fits (the shortest packs), many packs at a time:
it keeps counts of packing patterns, never packs. The patterns then say, for each length and rank, which sequence
and offset a piece has, and pieces look that up by their rank among those of their length.

Ranks never gather a length in one task: each length has as many salts as it needs, pieces get one by a hash, ranks run inside
(length, salt), and the salts' counts are added up first.

Defined cases: null and empty texts are the end id alone; equal pieces are interchangeable; repeated rows are packed as
often as they come; an empty table gives an empty result. Extra columns do not matter.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import batch, released, text_chunks
from .common import checkpointed
from .tokens import task_encoder

LENGTH = 4096
#: Pieces of one length that are ranked together, about.
PER_SALT = 1000

_PIECE_SQL = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"
_PIECE = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """Cuts of every document: whole sequences, then what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_encoder(tokenizer) as words:
            for part, texts in text_chunks(batches):
                out = [[] for _ in _PIECE]
                for k, ids in zip(part.column(0).to_pylist(), words.encode(texts), strict=True):
                    raw = memoryview(ids.astype("<u4").tobytes())
                    for a in range(0, len(ids), length):
                        own = raw[4 * a : 4 * (a + length)]
                        for column, value in zip(out, (k, a, len(own) // 4, zlib.crc32(own), len(ids)), strict=True):
                            column.append(value)
                yield batch(_PIECE, out)

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(released(run), _PIECE_SQL)


def plan(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths, longest first) and their counts. Work and result are bounded by the bins, not the pieces."""
    open_packs: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            room = max((r for r in open_packs if r >= size), default=None)
            if room is None:
                open_packs[length - size][(size,)] += left
                break
            patterns = open_packs[room]
            pattern = next(iter(patterns))
            used = min(left, patterns[pattern])
            patterns[pattern] -= used
            if not patterns[pattern]:
                del patterns[pattern]
            if not patterns:
                del open_packs[room]
            open_packs[room - size][(*pattern, size)] += used
            left -= used
    found = [(p, n) for packs in open_packs.values() for p, n in packs.items()]
    return sorted(found, reverse=True)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """For each length: runs of ranks (first rank, count) with the first sequence and the offset they get."""
    used, sequence, out = defaultdict(int), 0, []
    for pattern, n in patterns:
        offset = 0
        for size in pattern:
            out.append((size, used[size], n, sequence, offset))
            used[size] += n
            offset += size
        sequence += n
    return out


def pack(cut: DataFrame, length: int = LENGTH) -> DataFrame:
    """The pieces with sequence_id and offset. ``cut`` is read twice, so it is checkpointed first."""
    spark = cut.sparkSession
    cut = checkpointed(cut)
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = slots(plan(histogram, length))
    # one row for each bin of the histogram, at most ``length`` of them
    salts = spark.createDataFrame([(size, max(1, n // PER_SALT)) for size, n in histogram.items()], "length int, salts long")
    hashed = F.xxhash64("doc_id", "start", "ids_crc32")
    salted = cut.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(hashed, F.col("salts"))).drop("salts")
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = counts.select("length", "salt", (F.sum("n").over(so_far) - F.col("n")).alias("base"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        salted.withColumn("nth", F.row_number().over(inside) - 1)
        .join(bases, ["length", "salt"])
        .withColumn("rank", F.col("base") + F.col("nth"))
    )
    # runs are bounded by the bins: patterns end at the sequence length and each bin opens or closes few of them
    table = spark.createDataFrame(_by_length(runs), "length int, firsts array<long>, counts array<long>, sequences array<long>, offsets array<int>")
    joined = ranked.join(F.broadcast(table) if len(runs) < 200_000 else table, "length")
    at = F.expr(
        "aggregate(sequence(0, cast(ceil(log2(size(firsts) + 1)) as int)), named_struct('low', 0, 'high', size(firsts)), "
        "(s, _) -> if(s.low >= s.high, s, if(get(firsts, cast((s.low + s.high) div 2 as int)) <= rank, "
        "named_struct('low', cast((s.low + s.high) div 2 as int) + 1, 'high', s.high), "
        "named_struct('low', s.low, 'high', cast((s.low + s.high) div 2 as int)))), s -> s.low - 1)"
    )
    placed = joined.withColumn("at", at)
    return placed.select(
        "doc_id",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.get("sequences", F.col("at")) + F.col("rank") - F.get("firsts", F.col("at"))).alias("sequence_id"),
        F.get("offsets", F.col("at")).cast("long").alias("offset"),
    )


def _by_length(runs: list[tuple[int, int, int, int, int]]) -> list[tuple[int, list, list, list, list]]:
    found = defaultdict(lambda: ([], [], [], []))
    for size, *run in runs:
        for column, value in zip(found[size], run, strict=True):
            column.append(value)
    return [(size, *columns) for size, columns in found.items()]


def packed(docs: DataFrame, **how) -> DataFrame:
    return pack(pieces(docs, **how))


__all__ = ["pack", "packed", "pieces", "plan", "slots"]
