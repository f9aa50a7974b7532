"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Columns of the incidence are dealt into blocks by shingle hash, rows into blocks by document. In order:

1. Every document becomes a set of shingle hashes. Column blocks count in how many documents each shingle occurs; only
   shingles of at least two documents go back to the row blocks, in the order of rarity (count, then hash).
2. A document with too few shared shingles to overlap anything by the threshold is discarded by size alone. Documents with
   equal sets become one class.
3. Two sets over the threshold share a shingle among their rarest n - ceil(t n) + 1. Those prefixes are the columns of the
   product, block by block. First each class meets the first class of its columns (its star's centre, linear in the
   postings); overlaps accumulate and the one it shares most with is compared on whole sets; components are formed.
   Then stars that hold several components are multiplied in blocks of whole sets, which give out links only, however
   many members a star has. Then the products between different components and stars are accumulated, pairs whose
   accumulated overlap cannot reach the size-derived bound are discarded, and the others are compared on whole sets.
   Pairs inside a component need no product: they cannot change it.

A shingle that one chunk of a map task meets in ``HOT`` documents is settled in the map: its postings go straight to the
row blocks, marked as most frequent, and its column block gets one entry. No column thus gathers a large share of the rows.

Words are compared by 64-bit hashes and shingles by 48 bits of one; only collisions inside one pair of documents could
matter (about one in 10**9 for pairs of 500 shingles).

Defined cases: documents without words or with null text have an empty set, link with nothing and are their own component;
fewer than five words make one shingle of all words; repeated rows come back as often as they came, in one component with
their equals; an empty table gives an empty result. Extra columns do not matter. A row with a null key is a document of its
own: inside it is known by a hash of the whole row, far below other keys (so it comes before them), its doc_id is null again in
the result, and class_id and component_id keep the hash, so that several null keys do not become one. Repeated rows with null
keys have equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import arrays, batch, cells, grouped, mixed, released, runs, sized, text_chunks, word_hashes
from .common import checkpointed, free_name

WORDS = 5
#: The threshold as a fraction of whole numbers: 100 * intersection >= 80 * union.
NEED, OF = 80, 100
#: Documents of one chunk from which a shingle counts as most frequent everywhere.
HOT = 64
#: Shingles that one block holds, about.
PER_BLOCK = 4_000_000
#: Shingles of a column block that are counted together, at most about.
PER_PASS = 500_000
#: A class belongs to its centre's star from this share of common shingles (of the union, in percent) up.
CLOSE = 50
#: Classes that one block of a star's product has as rows, and as columns, about.
STAR_BLOCK = 512
_MOST = np.uint32(0xFFFFFFFF)
_ODD = np.random.default_rng(77).integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def pack(hashes: np.ndarray) -> bytes:
    """48-bit values, six bytes each."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack(raw: bytes | pa.Buffer | np.ndarray) -> np.ndarray:
    whole = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(whole), 8), np.uint8)
    out[:, :6] = whole
    return out.view("<u8").ravel()


def shingles(texts: list[bytes], size: int = WORDS) -> list[np.ndarray]:
    """The distinct shingle hashes (64 bits) of each text, sorted."""
    starts, hashes = word_hashes(b"\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    edges = np.r_[0, np.searchsorted(starts, ends)]
    del starts
    n = len(hashes) - size + 1
    whole = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        whole += hashes[k : k + n] * _ODD[k]
    whole = mixed(whole)
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            few = (hashes[a:b] * _ODD[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mixed(np.array([few], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_PACKET = [
    ("bucket", pa.int32()), ("block", pa.int32()), ("ids", pa.binary()), ("uids", pa.binary()), ("lens", pa.binary()),
    ("hashes", pa.binary()), ("counts", pa.binary()), ("facts", pa.binary()),
]
_PACKET_SQL = "bucket int, block int, ids binary, uids binary, lens binary, hashes binary, counts binary, facts binary"


def _split(key: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of each key value that occurs."""
    order = np.argsort(key, kind="stable")
    starts, lengths = runs(key[order])
    for s, m in zip(starts, lengths, strict=True):
        yield int(key[order[s]]), order[s : s + m]


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(16)) % np.uint64(n)).astype(np.int32)


def _packets(columns: int, rows: int):
    """Map side: documents to packets of column blocks, and to packets of facts that only pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            sets = shingles(texts)
            del texts
            n = np.array([len(s) for s in sets], np.int64)
            one = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
            two = np.array([mixed(s ^ np.uint64(0x1234567)).sum(dtype=np.uint64) for s in sets], np.uint64)
            missing = part.column(2).to_numpy(zero_copy_only=False).astype(np.uint64)
            uids = mixed(ids.view(np.uint64)) ^ one
            size = len(sets)
            low = np.concatenate(sets)
            del sets
            low &= np.uint64(0xFFFFFFFFFFFF)
            owner = np.repeat(np.arange(size, dtype=np.int32), n)
            order = np.argsort(low, kind="stable")
            starts, lengths = runs(low[order])
            hot = np.zeros(len(low), bool)
            hot[order] = np.repeat(lengths >= HOT, lengths)
            marked = low[order[starts[lengths >= HOT]]]
            del order, starts, lengths
            out = [[] for _ in _PACKET]

            def put(bucket, block, who, counts, hashes, times, facts, out=out, ids=ids, uids=uids):
                for column, value in zip(out, (bucket, block, ids[who].tobytes(), uids[who].tobytes(), counts.astype("<u4").tobytes(), pack(hashes), times, facts), strict=True):
                    column.append(value)

            cold = np.flatnonzero(~hot)
            for bucket, at in _split(_bucket(low[cold], columns), columns):
                at = np.sort(cold[at])
                s, m = runs(owner[at])
                put(bucket, -1, owner[at[s]], m, low[at], b"", b"")
            del cold
            for bucket, at in _split(_bucket(marked, columns), columns):
                put(bucket, -2, np.zeros(0, np.int64), np.zeros(0), marked[at], b"", b"")
            blocks = (uids % np.uint64(rows)).astype(np.int32)
            warm = np.flatnonzero(hot)
            edges = np.searchsorted(owner[warm], np.arange(size + 1))
            for block, who in _split(blocks, rows):
                m = edges[who + 1] - edges[who]
                own = np.concatenate([warm[edges[w] : edges[w + 1]] for w in who])
                facts = np.stack([n[who].view(np.uint64), one[who], two[who], missing[who]]).astype("<u8").tobytes()
                put(block % columns, block, who, m, low[own], np.full(len(own), _MOST).tobytes(), facts)
            del low, owner, hot
            yield batch(_PACKET, out)

    return run


def _count(columns: int, rows: int):
    """Column blocks: document counts, and the shared shingles back to the row blocks.

    A block is counted in passes by the lowest bits of the hashes, so that only a part of it is unpacked and sorted at a time.
    """

    def run(_, table: pa.Table) -> Iterator[pa.RecordBatch]:
        kind = table["block"].to_numpy().copy()  # views would keep the table
        yield from table.filter(pa.array(kind >= 0)).to_batches()
        if not (kind == -1).any():
            return
        whole = cells(table["hashes"])
        raw = np.concatenate([v for v, k in zip(whole, kind, strict=True) if k == -1]).reshape(-1, 6)
        marked = np.concatenate([np.zeros(0, np.uint64), *(unpack(v) for v, k in zip(whole, kind, strict=True) if k == -2)])
        ids, uids, lens = (np.concatenate(arrays(table[c], t)) for c, t in (("ids", "<i8"), ("uids", "<u8"), ("lens", "<u4")))
        counted = np.repeat(kind == -1, [len(v) // 8 for v in cells(table["ids"])])  # rows that only pass have ids too
        ids, uids, lens = ids[counted], uids[counted], lens[counted]
        del table, whole, counted
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), lens)  # places in ids and uids
        last = np.uint8((1 << min(8, (len(raw) // PER_PASS).bit_length())) - 1)
        turn, found = raw[:, 0] & last, []
        for k in range(int(last) + 1):
            at = np.flatnonzero(turn == k)
            hashes = unpack(raw[at])
            order = np.argsort(hashes, kind="stable")
            hashes, own = hashes[order], owner[at[order]]
            starts, lengths = runs(hashes)
            counts = lengths.astype(np.uint32)
            counts[np.isin(hashes[starts], marked[marked & np.uint64(last) == k])] = _MOST
            often = counts >= 2
            shared = np.repeat(often, lengths)
            found.append((hashes[shared], own[shared], np.repeat(counts[often], lengths[often])))
        del raw, owner, turn, at, order, own, starts, lengths, often, shared
        hashes, owner, times = (np.concatenate(x) for x in zip(*found, strict=True))
        del found
        for block, some in _split((uids % np.uint64(rows)).astype(np.int32)[owner], rows):
            own = owner[some]
            places = some[np.lexsort((ids[own], uids[own]))]
            who = owner[places]
            s, m = runs(uids[who])
            yield batch(
                _PACKET,
                [[0], [block], [ids[who[s]].tobytes()], [uids[who[s]].tobytes()], [m.astype("<u4").tobytes()], [pack(hashes[places])], [times[places].astype("<u4").tobytes()], [b""]],
            )

    return run


_DOC_SQL = "id long, n long, one long, two long, missing long, shared long, ordered binary"
_DOC = [
    ("id", pa.int64()), ("n", pa.int64()), ("one", pa.int64()), ("two", pa.int64()), ("missing", pa.int64()), ("shared", pa.int64()),
    ("ordered", pa.binary()),
]


def _assemble(_, table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Row blocks: each document's shared shingles, rarest first; none if size alone rules out any partner."""
    lens = np.concatenate(arrays(table["lens"], "<u4"))
    uids = np.repeat(np.concatenate(arrays(table["uids"], "<u8")), lens)
    hashes = unpack(np.concatenate(cells(table["hashes"])))
    counts = np.concatenate(arrays(table["counts"], "<u4"))
    order = np.lexsort((hashes, counts, uids))
    same = (np.diff(uids[order]) == 0) & (np.diff(hashes[order]) == 0) & (np.diff(counts[order]) == 0) if len(order) else np.zeros(0, bool)
    order = order[np.r_[True, ~same]] if len(order) else order
    uids, hashes = uids[order], hashes[order]
    del order, same, counts
    for row in table.to_batches():
        for ids, own, facts in zip(arrays(row["ids"], "<i8"), arrays(row["uids"], "<u8"), row["facts"].to_pylist(), strict=True):
            if not facts:
                continue
            n, one, two, missing = np.frombuffer(facts, "<u8").reshape(4, -1)
            low, high = np.searchsorted(uids, own), np.searchsorted(uids, own, side="right")
            blobs = [
                pack(hashes[a:b]) if k and OF * (b - a) >= NEED * k else None
                for a, b, k in zip(low, high, n.astype(np.int64), strict=True)
            ]
            yield batch(_DOC, [ids, n.view(np.int64), one.view(np.int64), two.view(np.int64), missing.view(np.int64), high - low, blobs])


_POST_SQL = "bucket int, hashes binary, who binary, n binary, label binary, star binary"
_POST = [("bucket", pa.int32()), ("hashes", pa.binary()), ("who", pa.binary()), ("n", pa.binary()), ("label", pa.binary()), ("star", pa.binary())]


def _prefixes(columns: int):
    """Classes to postings of their prefixes, packed by column block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rep, n, label, star = (part.column(k).to_numpy() for k in ("rep", "n", "label", "star"))
            sets = cells(part.column("ordered"))
            held = np.array([len(s) // 6 for s in sets], np.int64)
            size = np.maximum(n - -(-NEED * n // OF) + 1 - (n - held), 0)
            hashes = unpack(np.concatenate([np.zeros(0, np.uint8), *(s[: 6 * k] for s, k in zip(sets, size, strict=True))]))
            owner = np.repeat(np.arange(len(sets)), np.minimum(size, held))
            out = [[] for _ in _POST]
            for bucket, at in _split(_bucket(hashes, columns), columns):
                who = owner[at]
                for column, value in zip(out, (bucket, pack(hashes[at]), rep[who].tobytes(), n[who].tobytes(), label[who].tobytes(), star[who].tobytes()), strict=True):
                    column.append(value)
            yield batch(_POST, out)

    return run


def _lists(table: pa.Table):
    hashes = unpack(np.concatenate(cells(table["hashes"])))
    who, n, label, star = (np.concatenate(arrays(table[k], "<i8")) for k in ("who", "n", "label", "star"))
    order = np.lexsort((who, hashes))
    starts, lengths = runs(hashes[order])
    return order, starts, lengths, who, n, label, star


_PAIR_SQL = "a long, b long, na long, nb long, hits long"
_PAIR = [("a", pa.int64()), ("b", pa.int64()), ("na", pa.int64()), ("nb", pa.int64()), ("hits", pa.int64())]


def _summed(a, b, na, nb) -> pa.RecordBatch:
    """Pairs of one block with their counts."""
    order = np.lexsort((b, a))
    a, b, na, nb = a[order], b[order], na[order], nb[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    s = np.flatnonzero(new)
    return batch(_PAIR, [a[s], b[s], na[s], nb[s], np.diff(np.r_[s, len(a)])])


def _near(na: np.ndarray, nb: np.ndarray, need: int = NEED) -> np.ndarray:
    return OF * np.minimum(na, nb) >= need * np.maximum(na, nb)


def _stars(_, table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Each class with the first class of each of its columns."""
    order, starts, lengths, who, n, _, _ = _lists(table)
    head = order[np.repeat(starts, lengths)]
    keep = (who[order] != who[head]) & _near(n[order], n[head])
    a, b = head[keep], order[keep]
    yield _summed(who[a], who[b], n[a], n[b])


def _products(_, table: pa.Table) -> Iterator[pa.RecordBatch]:
    """All products of a column block between different components and stars, within the size bound."""
    order, starts, lengths, who, n, label, star = _lists(table)
    held, size = [], 0
    for s, m in zip(starts[lengths > 1], lengths[lengths > 1], strict=True):
        rows = order[s : s + m]
        if (label[rows] == label[rows[0]]).all() or (star[rows] == star[rows[0]]).all():
            continue
        for i in range(m - 1):
            rest = rows[i + 1 :]
            rest = rest[(label[rest] != label[rows[i]]) & (star[rest] != star[rows[i]]) & _near(n[rest], n[rows[i]])]
            if len(rest):
                held.append((np.full(len(rest), rows[i]), rest))
                size += len(rest)
            if size > 500_000:
                a, b = (np.concatenate(x) for x in zip(*held, strict=True))
                yield _summed(who[a], who[b], n[a], n[b])
                held, size = [], 0
    if held:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        yield _summed(who[a], who[b], n[a], n[b])


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with the overlap of whole sets: a, b, na, nb, both. Side b's set travels once for each of its pairs."""
    left = sets.select(F.col("rep").alias("a"), F.col("ordered").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("ordered").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            a, b, na, nb = (part.column(k).to_numpy() for k in ("a", "b", "na", "nb"))
            both = [
                len(np.intersect1d(unpack(x), unpack(y)))
                for x, y in zip(cells(part.column("sa")), cells(part.column("sb")), strict=True)
            ]
            yield batch(_PAIR, [a, b, na, nb, both])

    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "na", "nb", "sa", "sb")
    return joined.mapInArrow(released(run), _PAIR_SQL).withColumnRenamed("hits", "both")


def _links(need: int = NEED) -> Column:
    return F.expr(f"{OF} * both >= {need} * (na + nb - both)")


_EDGE = [("a", pa.int64()), ("b", pa.int64())]


def _multiply(need: int):
    """The links of one block of a star's product: rows outside the centre's component with all columns of the block."""

    def run(rows: pa.Table, columns: pa.Table) -> pa.Table:
        found = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        if rows.num_rows and columns.num_rows:
            sets = [unpack(v) for v in columns["ordered"].to_pylist()]
            rep, n, label = (columns[k].to_numpy() for k in ("rep", "n", "label"))
            known, code = np.unique(np.concatenate(sets), return_inverse=True)
            starts = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
            for r, m, own, raw in zip(*(rows[k].to_pylist() for k in ("rep", "n", "label", "ordered")), strict=True):
                flags = np.zeros(len(known), np.int32)
                mine = unpack(raw)
                at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                flags[at[known[at] == mine]] = 1
                both = np.add.reduceat(flags[code], starts)
                good = (label != own) & (OF * both >= need * (n + m - both))
                found[0].append(rep[good])
                found[1].append(np.full(int(good.sum()), r))
        return pa.Table.from_batches([batch(_EDGE, [np.concatenate(x) for x in found])])

    return run


def _star_products(stars: DataFrame, labels: DataFrame, classes: DataFrame, need: int = NEED) -> DataFrame:
    """Links inside stars whose members are not yet in one component.

    A star is a centre and the classes near it. Members in the centre's component need no product with each other; every
    other member meets all members, cell by cell of a grid. Only links leave a cell, never the pairs that were compared.
    """
    members = stars.select(F.col("a").alias("star"), F.col("b").alias("rep"))
    members = members.unionByName(members.select("star", F.col("star").alias("rep")).distinct())
    named = members.join(classes.select("rep", "n", "ordered"), "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.withColumn("label", F.coalesce("label", "rep"))
    facts = named.groupBy("star").agg(
        F.count("*").alias("size"),
        F.min("label").alias("low"),
        F.max("label").alias("high"),
        F.max(F.when(F.col("rep") == F.col("star"), F.col("label"))).alias("centre"),
    ).where("low <> high")
    mixed_stars = named.join(facts.select("star", "size", "centre"), "star").withColumn(
        "blocks", F.ceil(F.col("size") / F.lit(STAR_BLOCK)).cast("int")
    )
    # a grid of row blocks and column blocks, so no task holds a whole star
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = lambda df, down, across: df.select("star", down.alias("down"), across.alias("across"), "rep", "n", "label", "ordered")
    columns, rows = cells(mixed_stars, every, own), cells(mixed_stars.where("label <> centre"), own, every)
    cell = ("star", "down", "across")
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  both sides have one origin
    return fresh(rows).groupBy(*cell).cogroup(fresh(columns).groupBy(*cell)).applyInArrow(_multiply(need), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) edges by alternating large and small stars: node, label (the smallest node).

    It ends when every node points at one node that itself points nowhere, which is exactly when a round changes nothing.
    """
    now = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            now.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        )
        open_ = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")
        if not open_.take(1):
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            lower.select("u", F.col("m").alias("v"))
        )
        now = checkpointed(small.where("u <> v").distinct())


def _identity(docs: DataFrame, key: str) -> Column:
    """The key as a long; for a null key a hash of the whole row, from -2**63 up to -2**62."""
    row = F.to_json(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]))
    hashed = F.lit(-(2**63)) + F.shiftrightunsigned(F.xxhash64(row), 2)
    return F.coalesce(F.col(key).cast("long"), hashed)


def _joined(docs: DataFrame, key: str, text: str, units: int | None) -> DataFrame:
    """One row per document: id (see ``_identity``), missing (1 for a null key), n_shingles, class_id, component_id."""
    slim = docs.select(_identity(docs, key).alias("id"), F.col(text).alias("text"), F.col(key).isNull().alias("missing"))
    if units is None:
        units = (docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0) // 6 + 1
    n = sized(docs, units, PER_BLOCK)
    packets = slim.mapInArrow(released(_packets(n, n)), _PACKET_SQL)
    counted = grouped(packets, "bucket", n, _count(n, n), _PACKET_SQL)
    rows = checkpointed(grouped(counted, "block", n, _assemble, _DOC_SQL))
    classes = rows.where(F.col("ordered").isNotNull()).groupBy("n", "one", "two").agg(
        F.min("id").alias("rep"), F.first("ordered").alias("ordered")
    )
    classes = checkpointed(classes)
    sets = classes.select("rep", "ordered")

    def product(step, labels: DataFrame | None, near: DataFrame | None) -> DataFrame:
        named = classes.withColumns({"label": F.col("rep"), "star": F.col("rep")})
        if labels is not None:
            named = (
                classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
                .join(near.select(F.col("b").alias("rep"), F.col("a").alias("star")), "rep", "left")
                .withColumns({"label": F.coalesce("label", "rep"), "star": F.coalesce("star", "rep")})
            )
        posts = named.select("rep", "n", "label", "star", "ordered").mapInArrow(released(_prefixes(n)), _POST_SQL)
        found = grouped(posts, "bucket", n, step, _PAIR_SQL)
        return found.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("hits").alias("hits"))

    stars = product(_stars, None, None).groupBy("b").agg(F.max_by(F.struct("a", "na", "nb"), F.struct("hits", -F.col("a"))).alias("p"))
    met = checkpointed(_compared(stars.select("p.a", "b", "p.na", "p.nb"), sets))
    first = met.where(_links()).select("a", "b")
    near = met.where(f"100 * both >= {CLOSE} * (na + nb - both)").select("a", "b")
    labels = components(first)
    inner = checkpointed(_star_products(near, labels, classes))
    edges = first.unionByName(inner)
    if inner.take(1):
        labels = components(edges)
    rest = lambda k: F.ceil(F.lit(NEED) * F.col(f"n{k}") / F.lit(OF)) - 1  # noqa: E731  what is left behind the prefix
    bound = F.ceil(F.lit(NEED) * (F.col("na") + F.col("nb")) / F.lit(OF + NEED))
    possible = F.col("hits") + F.greatest(rest("a"), rest("b")) >= bound
    others = checkpointed(_compared(product(_products, labels, near).where(possible), sets).where(_links()).select("a", "b"))
    final = components(edges.unionByName(others)) if others.take(1) else labels
    named = classes.select("n", "one", "two", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    return rows.select("id", "missing", "n", "one", "two").join(
        named.select("n", "one", "two", "rep", F.coalesce("label", "rep").alias("label")), ["n", "one", "two"], "left"
    ).select(
        "id",
        "missing",
        F.col("n").alias("n_shingles"),
        F.coalesce("rep", "id").alias("class_id"),
        F.coalesce("label", "id").alias("component_id"),
    )


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", units: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (smallest id with an equal set), component_id."""
    found = _joined(docs, key, text, units)
    return found.select(F.when(F.col("missing") == 0, F.col("id")).alias("doc_id"), "n_shingles", "class_id", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are the first of their component, with their own columns; of rows with one key the one with the least text."""
    found = checkpointed(_joined(docs, key, text, None))
    own, first = free_name(docs, "_own"), free_name(docs, "_first")
    firsts = found.where("id = component_id").select(F.col("id").alias(first))
    kept = docs.withColumn(own, _identity(docs, key)).join(firsts.distinct(), F.col(own) == F.col(first), "left_semi")
    if not firsts.groupBy(first).count().where("count > 1").take(1):
        return kept.drop(own)
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
    return kept.groupBy(own).agg(F.min_by(row, F.coalesce(F.col(text), F.lit(""))).alias("row")).select("row.*")


def _oracle(rounds: int = 12, words: int = WORDS, need: int = NEED, also: str = "") -> str:
    """The join as SQL over all pairs that share a shingle; labels go through ``rounds`` of least-label propagation."""
    labels = "l0 as (select doc_id, doc_id as label from w)"
    for k in range(rounds):
        labels += f""", l{k + 1} as (select l.doc_id, least(l.label, coalesce(m.label, l.label)) as label from l{k} l left join
  (select u as doc_id, min(label) as label from links join l{k} on doc_id = v group by 1) m on m.doc_id = l.doc_id)"""
    return rf"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') as w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) >= {words} then list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i+{words - 1}], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as g from w),
n as (select doc_id, count(*) as n, md5(string_agg(g, chr(10) order by g)) as h from s group by 1),
classes as (select doc_id, n, min(doc_id) over (partition by h) as class_id from n),
pairs as (select x.doc_id as u, y.doc_id as v, count(*) as hits from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
links as (select u, v from pairs join n p on p.doc_id = u join n q on q.doc_id = v where 100 * hits >= {need} * (p.n + q.n - hits)),
{labels}
select w.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(class_id, w.doc_id) as class_id, label as component_id{also}
from w left join classes using (doc_id) join l{rounds} using (doc_id)
"""


ORACLE = _oracle()
