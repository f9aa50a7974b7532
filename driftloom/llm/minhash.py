"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

1. Every document's set of shingles becomes a signature of ``SYMBOLS`` minimum hashes, ``BITS`` bits of each. Documents with
   equal sets become one class, so copies cost one row each from here on.
2. A signature is cut into chunks of ``CHUNK`` symbols. Two signatures that differ in at most ``DISTANCE`` symbols differ, by the
   pigeonhole principle, in at most ``ERRORS`` symbols of some chunk. Every choice of that many symbols is left out of every
   chunk and the rest becomes a key, so all pairs within the distance share a key.
3. Each class meets the first class of its keys and is compared, on whole sets, with the one that it shares most keys with:
   linear in the keys, which counts combined before the shuffle find. Components are formed. Classes at least half alike to
   that first class are in its star, and so are their stars; stars that hold several components are multiplied in blocks of whole
   sets, which give out links only.
4. Keys that still hold several components and stars are multiplied in a grid of blocks of signatures. Pairs within the distance
   leave the first key that they share and are compared on whole sets.

Two sets at the threshold differ in each symbol with a probability of 0.15; more than ``DISTANCE`` of 64 differ once in about
ten million pairs. Such a pair is lost unless other documents connect it; no pair is lost in any other way, and none is linked
without the comparison of whole sets.

Defined cases: null, empty and blank texts have no shingles and link with nothing; a document of fewer words than a shingle is
one shingle; repeated rows are equal sets; rows with equal keys but different texts are one node of the components; a null
key stands for itself, ordered before all keys; an empty table gives an empty result. Extra columns don't matter. A single
very long text is worked off in its own step of a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import batch, cells, mixed, released, text_chunks
from .common import checkpointed
from .ngram_join import _compared, _identity, _links, _near, _oracle, _star_products, components, pack, shingles

WORDS = 3
#: The threshold in percent.
NEED = 85
SYMBOLS, BITS, CHUNK = 64, 16, 4
CHUNKS = SYMBOLS // CHUNK
#: Signatures that differ in more symbols than this are no candidates.
DISTANCE = 26
#: Symbols that may differ in the best chunk of a candidate pair.
ERRORS = DISTANCE // CHUNKS
#: A class belongs to its head's star from this share of common shingles (of the union, in percent) up.
CLOSE = 50
#: Signatures that one block of a key's product has as rows, and as columns, about.
KEY_BLOCK = 2048
_TURN = np.random.default_rng(1_312).integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPREAD = np.random.default_rng(1_313).integers(0, 2**63, CHUNK + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``SYMBOLS`` symbols for each set of hashes; an empty set's row is all zero."""
    out = np.zeros((len(sets), SYMBOLS), np.uint16)
    held = np.flatnonzero([len(s) for s in sets])
    if len(held):
        whole = np.concatenate([sets[i] for i in held])
        starts = np.r_[0, np.cumsum([len(sets[i]) for i in held])[:-1]]
        for k in range(SYMBOLS):
            least = np.minimum.reduceat(whole * _TURN[k], starts)
            out[held, k] = mixed(least) & np.uint64((1 << BITS) - 1)
    return out


def keys(rows: np.ndarray) -> np.ndarray:
    """The index keys of signatures: for each chunk all ways to leave ``ERRORS`` symbols out, hashed to 64 bits."""
    chunk = rows.reshape(len(rows), CHUNKS, CHUNK).astype(np.uint64) + np.uint64(1)
    out = []
    for tag, left in enumerate(combinations(range(CHUNK), CHUNK - ERRORS)):
        code = np.full(chunk.shape[:2], tag + 1, np.uint64) * _SPREAD[CHUNK] + np.arange(CHUNKS, dtype=np.uint64)
        for k in left:
            code = mixed(code + chunk[:, :, k] * _SPREAD[k])
        out.append(code)
    return np.concatenate(out, axis=1)


_SKETCH = [("id", pa.int64()), ("missing", pa.bool_()), ("n", pa.int64()), ("one", pa.int64()), ("two", pa.int64()), ("signature", pa.binary())]
_SKETCH_SQL = "id long, missing boolean, n long, one long, two long, signature binary"
_SET = [("n", pa.int64()), ("one", pa.int64()), ("two", pa.int64()), ("ordered", pa.binary())]
_SET_SQL = "n long, one long, two long, ordered binary"


def _facts(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Size and two sums of each set, which tell sets apart."""
    n = np.array([len(s) for s in sets], np.int64)
    one = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
    two = np.array([mixed(s ^ np.uint64(0x1234567)).sum(dtype=np.uint64) for s in sets], np.uint64)
    return [n, one.view(np.int64), two.view(np.int64)]


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            sets = shingles(texts, size)
            yield batch(_SKETCH, [part["id"], part["missing"], *_facts(sets), [s.tobytes() for s in signatures(sets)]])

    return run


def _whole_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_chunks(batches):
            sets = shingles(texts, size)
            yield batch(_SET, [*_facts(sets), [pack(np.unique(s & np.uint64(0xFFFFFFFFFFFF))) for s in sets]])

    return run


def _posts(classes: DataFrame) -> DataFrame:
    """One row for each key of each class: key and the other columns but the signature."""
    others = [c for c in classes.columns if c != "signature"]
    schema = "key long, " + ", ".join(f"{c} long" for c in others)
    fields = [("key", pa.int64()), *((c, pa.int64()) for c in others)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                codes = keys(_rows(part["signature"]))
                repeated = [np.repeat(part[c].to_numpy(), codes.shape[1]) for c in others]
                yield batch(fields, [codes.ravel().view(np.int64), *repeated])

    return classes.mapInArrow(released(run), schema)


def _rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint8), *cells(column)]).view(np.uint16).reshape(-1, SYMBOLS)


_CELL = [("a", pa.int64()), ("b", pa.int64()), ("na", pa.int64()), ("nb", pa.int64())]


def _distances(need: int, distance: int):
    """One cell of a key's grid: pairs of different components and stars whose signatures are within the distance."""

    def run(rows: pa.Table, columns: pa.Table) -> pa.Table:
        found = [[np.zeros(0, np.int64)] for _ in _CELL]
        if rows.num_rows and columns.num_rows:
            whole, mine = _rows(columns["signature"]), _rows(rows["signature"])
            rep, n, label, star = (columns[k].to_numpy() for k in ("rep", "n", "label", "star"))
            theirs, ours, key = keys(whole), keys(mine), rows["key"].to_numpy().view(np.uint64)[0]
            centre = rows["centre"][0].as_py()
            for i, (r, m, own, near) in enumerate(zip(*(rows[k].to_pylist() for k in ("rep", "n", "label", "star")), strict=True)):
                at = np.flatnonzero((label != own) & (star != near) & _near(n, m, need))
                at = at[(whole[at] != mine[i]).sum(axis=1) <= distance]
                at = at[(label[at] == centre) | (rep[at] < r)]  # two rows meet twice
                same = theirs[at] == ours[i]
                at = at[ours[i][same.argmax(axis=1)] == key]  # the first key that both have gives the pair out
                lower = rep[at] < r
                for held, x, y in ((0, rep[at], r), (2, n[at], m)):
                    found[held].append(np.where(lower, x, y))
                    found[held + 1].append(np.where(lower, y, x))
        return pa.Table.from_batches([batch(_CELL, [np.concatenate(x) for x in found])])

    return run


def _key_products(members: DataFrame, need: int, distance: int) -> DataFrame:
    """Candidate pairs (a, b, na, nb) of different components and stars that share a key and are within the distance.

    A key's members in the component of its first need no product with each other, so these are columns only. Rows and
    columns are dealt into blocks; no task holds a whole key.
    """
    posts = _posts(members.select("rep", "label", "star", "signature"))
    open_ = (
        posts.groupBy("key")
        .agg(
            F.count("*").alias("size"),
            F.min(F.struct("rep", "label")).alias("head"),
            *(f("label").alias(f"{f.__name__}_label") for f in (F.min, F.max)),
            *(f("star").alias(f"{f.__name__}_star") for f in (F.min, F.max)),
        )
        .where("min_label <> max_label and min_star <> max_star")
        .select("key", F.col("head.label").alias("centre"), F.ceil(F.col("size") / F.lit(KEY_BLOCK)).cast("int").alias("blocks"))
    )
    met = posts.join(open_, "key").join(members.select("rep", "n", "signature"), "rep")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    grid = lambda df, down, across: df.select("key", down.alias("down"), across.alias("across"), "centre", "rep", "n", "label", "star", "signature")
    columns, rows = grid(met, every, own), grid(met.where("label <> centre"), own, every)
    cell = ("key", "down", "across")
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  both sides have one origin
    found = fresh(rows).groupBy(*cell).cogroup(fresh(columns).groupBy(*cell)).applyInArrow(_distances(need, distance), "a long, b long, na long, nb long")
    return found.distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, need: int = NEED) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (smallest id with an equal set), component_id, kept (first of its component)."""
    slim = docs.select(_identity(docs, key).alias("id"), F.col(text).alias("text"), F.col(key).isNull().alias("missing"))
    rows = checkpointed(slim.mapInArrow(released(_sketches(words)), _SKETCH_SQL))
    same = ["n", "one", "two"]
    classes = rows.where("n > 0").groupBy(*same).agg(F.min("id").alias("rep"), F.first("signature").alias("signature"))
    classes = checkpointed(classes)

    posts = _posts(classes.select("rep", "signature"))
    heads = posts.groupBy("key").agg(F.min("rep").alias("head"), F.count("*").alias("size")).where("size > 1").drop("size")
    hits = posts.join(heads, "key").where("rep <> head").groupBy("head", "rep").agg(F.count("*").alias("hits"))
    best = checkpointed(hits.groupBy(F.col("rep").alias("b")).agg(F.max_by("head", F.struct("hits", -F.col("head"))).alias("a")))
    active = best.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    alive = classes.join(active, "rep")
    texts = slim.join(active.withColumnRenamed("rep", "id"), "id").select("text")
    sets = texts.mapInArrow(released(_whole_sets(words)), _SET_SQL).dropDuplicates(same)
    full = checkpointed(alive.join(sets, same).select("rep", "n", "signature", "ordered"))

    size = lambda side: full.select(F.col("rep").alias(side), F.col("n").alias("n" + side))
    stars = best.join(size("a"), "a").join(size("b"), "b").select("a", "b", "na", "nb")
    met = checkpointed(_compared(stars, full.select("rep", "ordered")))
    first = met.where(_links(need)).select("a", "b")
    # a star takes in the stars of its members, so near texts of one family are in one
    near = components(met.where(f"100 * both >= {CLOSE} * (na + nb - both)").select("a", "b")).select(F.col("label").alias("a"), F.col("node").alias("b"))
    labels = components(first)
    inner = checkpointed(_star_products(near.where("a <> b"), labels, full, need))
    edges = first.unionByName(inner)
    if inner.take(1):
        labels = components(edges)
    members = (
        full.select("rep", "n", "signature")
        .join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .join(near.select(F.col("b").alias("rep"), F.col("a").alias("star")), "rep", "left")
        .withColumns({"label": F.coalesce("label", "rep"), "star": F.coalesce("star", "rep")})
    )
    pairs = _key_products(checkpointed(members), need, DISTANCE)
    others = checkpointed(_compared(pairs, full.select("rep", "ordered")).where(_links(need)).select("a", "b"))
    final = components(edges.unionByName(others)) if others.take(1) else labels
    named = classes.drop("signature").join(final.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    return rows.drop("signature").join(named, same, "left").select(
        F.when(~F.col("missing"), F.col("id")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.coalesce("rep", "id").alias("class_id"),
        F.coalesce("label", "id").alias("component_id"),
        (F.col("id") == F.coalesce("label", "id")).alias("kept"),
    )


ORACLE = _oracle(words=WORDS, need=NEED, also=", w.doc_id = label as kept")
