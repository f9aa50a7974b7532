"""Token counts by section, from one encoding of the whole document.

A document is encoded once, with the code-point span of each token. Tokens and sections are both in order, so the interval
join is a bisection of the tokens' ends in the sections' starts. The rule for a token over a boundary: it belongs to the
section with most of its characters, to the earlier of equals; a token without characters to the section at its start.
Tokens outside all sections count as outside. The sections' counts and the outside add up to the document's tokens.

Defined cases: null and empty texts have no tokens; null or empty section lists leave all tokens outside; empty sections
get none; repeated rows are counted each; an empty table gives an empty result. Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import batch, released, text_chunks
from .tokens import task_encoder


def allot(first: np.ndarray, last: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, int]:
    """Section of each token (-1: none) and how many tokens cross a boundary. Sections are in order and do not overlap."""
    if not len(starts) or not len(first):
        return np.full(len(first), -1, np.int64), 0
    low = np.searchsorted(starts, first, side="right") - 1
    high = np.searchsorted(starts, np.maximum(last - 1, first), side="right") - 1
    inside = (low >= 0) & (first < ends[np.maximum(low, 0)])
    own = np.where(inside, low, -1)
    over = np.flatnonzero((low != high) | (inside & (last > ends[np.maximum(low, 0)])))
    for t in over:
        near = np.arange(max(low[t], 0), high[t] + 1)
        share = np.minimum(last[t], ends[near]) - np.maximum(first[t], starts[near])
        best = int(np.argmax(share))
        own[t] = near[best] if share[best] > 0 else -1
    return own, len(over)


_OUT_SQL = "key long, n_chars long, n_tokens long, outside long, crossing long, counts array<long>"
_OUT = [
    ("key", pa.int64()), ("n_chars", pa.int64()), ("n_tokens", pa.int64()), ("outside", pa.int64()), ("crossing", pa.int64()),
    ("counts", pa.list_(pa.int64())),
]


def attribute(docs: DataFrame, sections: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row per document: key, n_chars, n_tokens, outside, crossing, counts (of the column ``sections``' items).

    ``sections`` is an array of structs whose first two fields are start and end in code points, in order, disjoint.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_encoder(tokenizer) as words:
            for part, texts in text_chunks(batches):
                out = [[] for _ in _OUT]
                words.learn_places(texts)
                keys, starts, ends = (part.column(part.schema.get_field_index(k)).to_pylist() for k in ("key", "starts", "ends"))
                for k, a, z, raw in zip(keys, starts, ends, texts, strict=True):
                    first, last = words.places(raw)
                    own, crossing = allot(first, last, np.array(a or [], np.int64), np.array(z or [], np.int64))
                    counts = np.bincount(own[own >= 0], minlength=len(a or []))
                    row = (k, len(raw.decode()), len(first), int((own < 0).sum()), crossing, counts.tolist())
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                yield batch(_OUT, out)

    slim = docs.select(
        F.col(key).cast("long").alias("key"),
        F.col(text).alias("text"),
        F.transform(sections, lambda s: s["start"].cast("long")).alias("starts"),
        F.transform(sections, lambda s: s["end"].cast("long")).alias("ends"),
    )
    return slim.mapInArrow(released(run), _OUT_SQL)


def thirds(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens of each third of every document's code points."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    cut = lambda k: F.floor(n * k / 3).cast("int")
    spans = F.array(*[F.struct(cut(k).alias("start"), cut(k + 1).alias("end")) for k in range(3)])
    counted = attribute(docs.select(F.col(key).alias("k"), F.col(text).alias("t"), spans.alias("s")), "s", "k", "t")
    return counted.select(
        F.col("key").alias("doc_id"),
        "n_chars",
        "n_tokens",
        *[F.get("counts", F.lit(k)).alias(f"{name}_tokens") for k, name in enumerate(("head", "middle", "tail"))],
        F.col("crossing").alias("crossing_tokens"),
    )
