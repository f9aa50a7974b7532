"""Conversation structure repair as a time-major dynamic program over NumPy tensors.

``damage`` is the contract's deterministic damage. ``repair`` finds, for each conversation, the cheapest edits that make its roles
a system turn at most, then user and assistant turns in pairs:

1. Rows are range-sorted by conversation and turn and cut into pieces of at most ``PIECE`` rows of one conversation, which are
   written once. A long conversation spans several pieces and tasks; none holds it whole.
2. A row's fault is blank, duplicate (of an earlier row of the conversation) or truncated. Duplicates are settled inside a task
   by what it has seen; only the first rows of a task's texts meet those of other tasks.
3. Pieces of a task are bucketed by length and all pieces of a bucket go through the rows together, backwards in time: the cost
   from each of the four states (nothing yet, system, user, assistant) to each state behind the piece. For a
   conversation of several pieces these 4 x 4 blocks are chained by (min, +), one block for each piece, which gives the costs behind
   each piece.
4. With these, stored backward costs are traced forwards for all pieces of a bucket together, from each state that a piece
   may start in, taking the least letter (D, I, K, R) among the cheapest. As each letter leads to one state, the result is the
   ASCII-least string of edits.

Defined cases: null roles and texts count as one space, null turns come first, rows of one turn are ordered by role and text;
an identical row of one turn is a later one; a null conversation is a conversation of its own; an empty table gives an empty
result; extra columns don't matter. A piece ends at ``PIECE_BYTES`` of text; a longer text is a piece of its own. A conversation's
hash needs its text in order, so a long one is streamed through one task, a piece at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import batch, released
from .common import checkpointed

Parsed = tuple[np.ndarray, np.ndarray, np.ndarray]

#: Rows of a piece, and bytes of text from which it ends early.
PIECE, PIECE_BYTES = 2048, 4 << 20
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
USER, ASSISTANT = "user", "assistant"
#: Faults of a row; the first that holds counts.
SOUND, BLANK, DUPLICATE, CUT = range(4)
#: States: nothing yet, system, user, assistant. A conversation may end in the first and the last.
STATES = 4
#: The state behind an emitted role (system, user, assistant, any other) by state; -1 where the role isn't allowed.
AFTER = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
#: The one of user and assistant that each state allows, as the state behind it.
NEXT = np.array([2, 2, 3, 2])
#: More than any cost of a piece, and safe to add up.
FAR = np.int64(1) << 50
LETTERS = b"DIKR"


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, text) after the damage that crc32 of ``conv_id:turn`` modulo 20 decides; nulls count as one space."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.encode(F.concat(plain(conv), F.lit(":"), plain(turn)), "UTF-8")), F.lit(20))
    kept = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), plain(role).alias("role"), plain(text).alias("text"), kind.alias("kind"))
    own = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    changed = kept.where("kind <> 0").select("conv_id", "turn", F.when(F.col("kind") == 4, USER).otherwise(F.col("role")).alias("role"), own.alias("text"), copies.alias("copy"))
    return changed.drop("copy")


_PIECE = [
    ("conv", pa.int64()), ("none", pa.bool_()), ("part", pa.int32()), ("piece", pa.int32()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
    ("faults", pa.binary()), ("heads", pa.list_(pa.binary())), ("places", pa.list_(pa.int32())), ("illegal", pa.int64()),
    ("whole", pa.bool_()),
]
_PIECE_SQL = (
    "conv long, none boolean, part int, piece int, roles array<string>, texts array<string>, faults binary, heads array<binary>, places array<int>, illegal long, whole boolean"
)
STOPS, BLANKS = ".!?", " \t\n\x0b\x0c\r"
#: Adjacent first letters of roles that are in order.
LEGAL = {"su", "ua", "au"}


def _pieces(most: int):
    """Sorted rows of one partition to pieces, with the faults that the partition knows of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, seen, number, runs, size = TaskContext.get().partitionId(), None, set(), 0, 0, 0
        held: list[list] = [[], [], [], [], []]

        def piece(whole: bool) -> pa.RecordBatch:
            roles, texts, faults, heads, places = held
            wrong = sum(a[:1] + b[:1] not in LEGAL for a, b in zip(roles, roles[1:], strict=False))
            done = batch(_PIECE, [[now[0]], [now[1]], [part], [number], [list(roles)], [list(texts)], [bytes(faults)], [list(heads)], [list(places)], [wrong], [whole]])
            for column in held:
                column.clear()
            return done

        for rows in batches:
            for conv, none, role, text in zip(*(rows[c].to_pylist() for c in ("conv", "none", "role", "text")), strict=True):
                if (conv, none) != now:
                    if held[0]:
                        yield piece(number == 0 and runs > 1)  # neither the first nor the last of the partition
                    now, seen, number, runs, size = (conv, none), set(), 0, runs + 1, 0
                elif len(held[0]) >= most or size >= PIECE_BYTES:
                    yield piece(False)
                    number, size = number + 1, 0
                last = text.rstrip(BLANKS)[-1:]
                if not last:
                    fault = BLANK
                else:
                    code = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
                    fault = DUPLICATE if code in seen else SOUND if last in STOPS else CUT
                    if fault != DUPLICATE:
                        seen.add(code)
                        held[3].append(code)
                        held[4].append(len(held[0]))
                size += len(text)
                for column, value in zip(held[:3], (role, text, fault), strict=True):
                    column.append(value)
        if held[0]:
            yield piece(False)

    return run


def _codes(roles: pa.Array) -> np.ndarray:
    """System, user, assistant or other, by a role's first character."""
    first = pa.compute.utf8_slice_codeunits(roles, 0, 1).to_pylist()
    return np.array(["sua".find(c) if c else 3 for c in first], np.int64) % 4


def _tensors(part: pa.RecordBatch) -> Iterator[Parsed]:
    """Buckets of pieces of one length: their places, and roles and faults as (time, piece) arrays."""
    lists = part["roles"]
    codes, edges = _codes(lists.flatten()), np.asarray(lists.offsets) - lists.offsets[0].as_py()
    faults = np.frombuffer(b"".join(part["faults"].to_pylist()), np.uint8)
    lengths = np.diff(edges)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        rows = edges[at][None, :] + np.arange(n)[:, None]
        yield at, codes[rows], faults[rows]


def _inserted(cost: np.ndarray) -> np.ndarray:
    """Costs (piece, state, ...) after as many insertions in front as pay."""
    for _ in range(STATES - 1):
        cost = np.minimum(cost, INSERT + cost[:, NEXT])
    return cost


def _choices(role: np.ndarray, fault: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For one row of each piece: what keeping costs by state, the state behind it, and what a new role costs."""
    kept = AFTER[:, role].T
    must_go = (fault == BLANK) | (fault == DUPLICATE)
    more = np.where(fault == CUT, TRUNCATED, 0)
    keep = np.where((kept < 0) | must_go[:, None], FAR, more[:, None])
    return keep, np.maximum(kept, 0), np.where(must_go, FAR, more + REROLE)


def backward(roles: np.ndarray, faults: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Costs (time + 1, piece, state, end) from each state before each row on, for the costs (piece, state, end) behind the last."""
    out = np.empty((len(roles) + 1, *behind.shape), np.int64)
    out[-1] = cost = _inserted(behind)
    for t in range(len(roles) - 1, -1, -1):
        keep, kept, rerole = _choices(roles[t], faults[t])
        held = keep[:, :, None] + np.take_along_axis(cost, kept[:, :, None], 1)
        new = rerole[:, None, None] + cost[:, NEXT]
        out[t] = cost = np.minimum(_inserted(np.minimum(np.minimum(held, new), DELETE + cost)), FAR)
    return out


def trace(roles: np.ndarray, faults: np.ndarray, costs: np.ndarray, state: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The edits of each piece from its state on, and the state behind its last row, before insertions there.

    ``costs`` are (time + 1, piece, state), as ``backward`` stores them. The insertions behind a conversation's last row belong
    to what follows the piece.
    """
    n, time = roles.shape[1], np.zeros(roles.shape[1], np.int64)
    state, each, letters, owners = state.copy(), np.arange(n), [], []
    live = each[time < len(roles)]
    while len(live):
        t, q = time[live], state[live]
        keeps, after, rerole = _choices(roles[t, live], faults[t, live])
        here, keep, kept = costs[t, live, q], keeps[np.arange(len(live)), q], after[np.arange(len(live)), q]
        ways = np.stack([DELETE + costs[t + 1, live, q], INSERT + costs[t, live, NEXT[q]], keep + costs[t + 1, live, kept], rerole + costs[t + 1, live, NEXT[q]]])
        way = np.argmax(ways == here, axis=0)
        letters.append(way)
        owners.append(live)
        state[live] = np.choose(way, [q, NEXT[q], kept, NEXT[q]])
        time[live] = t + (way != 1)
        live = live[time[live] < len(roles)]
    if not letters:
        return [b""] * n, state
    owner, letter = np.concatenate(owners), np.frombuffer(LETTERS, np.uint8)[np.concatenate(letters)]
    order = np.argsort(owner, kind="stable")
    edges = np.searchsorted(owner[order], np.arange(n + 1))
    letter = letter[order]
    return [letter[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], state


#: Costs behind a conversation: it may end with nothing or with an assistant.
END = np.array([0, FAR, FAR, 0])
_IDS = ["conv", "none", "part", "piece"]
_ID = [("conv", pa.int64()), ("none", pa.bool_()), ("part", pa.int32()), ("piece", pa.int32())]
_ID_SQL = "conv long, none boolean, part int, piece int"


def _ids(part: pa.RecordBatch | pa.Table) -> list:
    return [part[c].to_pylist() for c in _IDS]


def _tail(state: int) -> bytes:
    """The insertions behind a conversation's last row."""
    return {0: b"", 3: b"", 2: b"I", 1: b"II"}[int(state)]


def _applied(edits: bytes, state: int, roles: list[str], texts: list[str]) -> list[dict[str, str]]:
    """The messages that the edits leave."""
    out, at = [], 0
    for letter in edits.decode():
        after = int(NEXT[state])
        if letter == "K":
            after = int(AFTER[state, "sua".find(roles[at][:1]) % 4])
        if letter != "D":
            out.append({"role": roles[at] if letter == "K" else (USER if after == 2 else ASSISTANT), "text": "" if letter == "I" else texts[at]})
            state = after
        at += letter != "I"
    return out


_MESSAGES = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_DONE = [*_ID, ("whole", pa.bool_()), ("audit", pa.string()), ("messages", _MESSAGES), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost"))]
_DONE_SQL = f"{_ID_SQL}, whole boolean, audit string, messages array<struct<role: string, text: string>>, blank long, duplicate long, truncated long, illegal long, cost long"


def _counted(faults: bytes) -> list[int]:
    return [faults.count(k) for k in (BLANK, DUPLICATE, CUT)]


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of one piece."""
    for part in batches:
        edits, cost = [b""] * part.num_rows, np.zeros(part.num_rows, np.int64)
        for at, roles, faults in _tensors(part):
            costs = backward(roles, faults, np.tile(END[None, :, None], (len(at), 1, 1)))[..., 0]
            found, state = trace(roles, faults, costs, np.zeros(len(at), np.int64))
            cost[at] = costs[0, :, 0]
            for i, e, q in zip(at, found, state, strict=True):
                edits[i] = e + _tail(q)
        rows = list(zip(edits, part["roles"].to_pylist(), part["texts"].to_pylist(), strict=True))
        counts = np.array([_counted(f) for f in part["faults"].to_pylist()]).reshape(-1, 3).T
        messages = [_applied(e, 0, r, t) for e, r, t in rows]
        yield batch(_DONE, [*_ids(part), part["whole"], [e.decode() for e in edits], messages, *counts, part["illegal"], cost])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of long conversations with late duplicates marked, and with their blocks of costs from state to state."""
    unit = np.where(np.eye(STATES, dtype=bool), 0, FAR)
    for part in batches:
        marked = []
        for raw, late in zip(part["faults"].to_pylist(), part["late"].to_pylist(), strict=True):
            own = bytearray(raw)
            for place in late or ():
                own[place] = DUPLICATE
            marked.append(bytes(own))
        part = part.set_column(part.schema.get_field_index("faults"), "faults", pa.array(marked, pa.binary()))
        blocks = [b""] * part.num_rows
        for at, roles, faults in _tensors(part):
            whole = backward(roles, faults, np.tile(unit, (len(at), 1, 1)))[0]
            for i, block in zip(at, whole, strict=True):
                blocks[i] = block.tobytes()
        ends = [[r[0][:1], r[-1][:1]] for r in part["roles"].to_pylist()]
        yield batch(_LONG, [*_ids(part), part["roles"], part["texts"], marked, part["illegal"], blocks, ends])


_LONG = [*_ID, ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("faults", pa.binary()), ("illegal", pa.int64()), ("block", pa.binary()), ("ends", pa.list_(pa.string()))]
_LONG_SQL = f"{_ID_SQL}, roles array<string>, texts array<string>, faults binary, illegal long, block binary, ends array<string>"
_BEHIND = [*_ID, ("behind", pa.binary()), ("cost", pa.int64()), ("border", pa.int64()), ("last", pa.bool_())]


def _chained(table: pa.Table) -> pa.Table:
    """One conversation's pieces: the costs behind each, and borders of roles out of order."""
    rows = table.sort_by([("part", "ascending"), ("piece", "ascending")])
    blocks = [np.frombuffer(b, np.int64).reshape(STATES, STATES) for b in rows["block"].to_pylist()]
    ends, costs = rows["ends"].to_pylist(), [_inserted(END[None])[0]]
    for block in blocks[:0:-1]:
        costs.append(np.minimum((block + costs[-1]).min(axis=1), FAR))
    total = int((blocks[0] + costs[-1]).min(axis=1)[0])
    border = [0, *(int(a[1] + b[0] not in LEGAL) for a, b in zip(ends, ends[1:], strict=False))]
    n = len(blocks)
    return pa.Table.from_batches([batch(_BEHIND, [*_ids(rows), [c.tobytes() for c in costs[::-1]], [total] + [0] * (n - 1), border, [False] * (n - 1) + [True]])])


_TRACED = [*_ID, ("last", pa.bool_()), ("edits", pa.list_(pa.binary())), ("states", pa.binary())]


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of pieces from each state that they may start in, and the states behind."""
    for part in batches:
        edits, states = [[] for _ in range(part.num_rows)], np.zeros((part.num_rows, STATES), np.int64)
        behind = np.frombuffer(b"".join(part["behind"].to_pylist()), np.int64).reshape(-1, STATES)
        for at, roles, faults in _tensors(part):
            costs = backward(roles, faults, behind[at][:, :, None])[..., 0]
            for start in range(STATES):
                found, states[at, start] = trace(roles, faults, costs, np.full(len(at), start))
                for i, e in zip(at, found, strict=True):
                    edits[i].append(e)
        yield batch(_TRACED, [*_ids(part), part["last"], edits, [q.tobytes() for q in states]])


_START = [*_ID, ("start", pa.int32()), ("tail", pa.binary())]


def _started(table: pa.Table) -> pa.Table:
    """One conversation's pieces with the states that they start in."""
    rows, state, starts = table.sort_by([("part", "ascending"), ("piece", "ascending")]), 0, []
    for raw in rows["states"].to_pylist():
        starts.append(state)
        state = int(np.frombuffer(raw, np.int64)[state])
    tails = [b""] * (len(starts) - 1) + [_tail(state)]
    return pa.Table.from_batches([batch(_START, [*_ids(rows), starts, tails])])


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        rows = list(zip(part["edits"].to_pylist(), part["start"].to_pylist(), part["tail"].to_pylist(), part["roles"].to_pylist(), part["texts"].to_pylist(), strict=True))
        edits = [(e[q] + tail, q, r, t) for e, q, tail, r, t in rows]
        counts = np.array([_counted(f) for f in part["faults"].to_pylist()]).reshape(-1, 3).T
        illegal = part["illegal"].to_numpy() + part["border"].to_numpy()
        yield batch(_DONE, [*_ids(part), [False] * len(edits), [e[0].decode() for e in edits], [_applied(*e) for e in edits], *counts, illegal, part["cost"]])


def _long(pieces: DataFrame) -> DataFrame:
    """Conversations of several pieces, or that may go on in another task's partition."""
    conv = ["conv", "none"]
    heads = pieces.select(*_IDS, F.explode(F.arrays_zip("heads", "places")).alias("h")).select(*_IDS, "h.heads", "h.places")
    # a task sends each text once, so that a text has at most as many rows here as its conversation has tasks
    met = heads.groupBy(*conv, "heads").agg(F.sort_array(F.collect_list(F.struct("part", "piece", "places"))).alias("at")).where(F.size("at") > 1)
    late = met.select(*conv, F.explode(F.slice("at", F.lit(2), F.size("at"))).alias("x")).groupBy(*conv, "x.part", "x.piece").agg(F.collect_list("x.places").alias("late"))
    marked = checkpointed(pieces.join(late, _IDS, "left").mapInArrow(released(_marked), _LONG_SQL))
    behind = checkpointed(marked.select(*_IDS, "block", "ends").groupBy(*conv).applyInArrow(_chained, f"{_ID_SQL}, behind binary, cost long, border long, last boolean"))
    facts = marked.select(*_IDS, "roles", "faults").join(behind, _IDS)
    traced = checkpointed(facts.mapInArrow(released(_traced), f"{_ID_SQL}, last boolean, edits array<binary>, states binary"))
    starts = traced.select(*_IDS, "states").groupBy(*conv).applyInArrow(_started, f"{_ID_SQL}, start int, tail binary")
    found = traced.select(*_IDS, "edits").join(starts, _IDS).join(behind.select(*_IDS, "cost", "border"), _IDS)
    return marked.join(found, _IDS).mapInArrow(released(_finished), _DONE_SQL)


def repair(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most: int = PIECE
) -> DataFrame:
    """One row per piece of a conversation, in the order of (part, piece): conv and none (the id, 0 and true for null), whole
    (the only piece), audit (its edits), messages (role, text; what the edits leave), blank, duplicate, truncated, illegal, cost."""
    plain = lambda c: F.coalesce(F.col(c), F.lit(" "))
    known = rows.select(
        F.coalesce(F.col(conv).cast("long"), F.lit(0)).alias("conv"),
        F.col(conv).isNull().alias("none"),
        F.col(turn).alias("turn"),
        plain(role).alias("role"),
        plain(text).alias("text"),
    )
    # bounds are sampled to the driver, so they see a text's beginning only; equal beginnings share a partition
    dealt = known.withColumn("opening", F.substring("text", 1, 64)).repartitionByRange("none", "conv", F.asc_nulls_first("turn"), "role", "opening")
    ordered = dealt.sortWithinPartitions("none", "conv", F.asc_nulls_first("turn"), "role", "text").select("conv", "none", "role", "text")
    pieces = checkpointed(ordered.mapInArrow(released(_pieces(most)), _PIECE_SQL))
    return pieces.where("whole").mapInArrow(released(_solved), _DONE_SQL).unionByName(_long(pieces.where("not whole")))


_REPORT = [("conv", pa.int64()), ("none", pa.bool_()), ("audit", pa.string()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), ("repaired_sha256", pa.string())]
_REPORT_SQL = "conv long, none boolean, audit string, blank long, duplicate long, truncated long, illegal long, cost long, repaired_sha256 string"


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces of conversations to one row each; texts go through the hash a piece at a time."""
    now, sums, audits, hashed, begun = None, None, [], None, False

    def row() -> pa.RecordBatch:
        return batch(_REPORT, [[now[0]], [now[1]], ["".join(audits)], *([int(x)] for x in sums), [hashed.hexdigest()]])

    for part in batches:
        for conv, none, audit, said, empty, *counts in zip(*(part[c].to_pylist() for c in ("conv", "none", "audit", "said", "empty", "blank", "duplicate", "truncated", "illegal", "cost")), strict=True):
            if (conv, none) != now:
                if now is not None:
                    yield row()
                now, sums, audits, hashed, begun = (conv, none), np.zeros(5, np.int64), [], hashlib.sha256(), False
            audits.append(audit)
            sums += counts
            if not empty:
                hashed.update(("\n" * begun + said).encode())
                begun = True
    if now is not None:
        yield row()


def digest(repaired: DataFrame, rows: DataFrame, every: DataFrame) -> DataFrame:
    """One row per conversation of ``every`` (conv_id): gaps of the turns of ``rows``, counts, cost, audit, and the hash of what ``repair`` left."""
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    shown = repaired.withColumns({"said": said, "empty": F.size("messages") == 0}).drop("messages")
    names = ["conv", "none", "audit", "blank", "duplicate", "truncated", "illegal", "cost"]
    whole = shown.where("whole").select(*names, F.sha2(F.encode("said", "UTF-8"), 256).alias("repaired_sha256"))
    parts = shown.where("not whole").repartition("conv", "none").sortWithinPartitions("conv", "none", "part", "piece")
    found = whole.unionByName(parts.mapInArrow(_streamed, _REPORT_SQL))
    ids = [F.coalesce(F.col("conv_id"), F.lit(0)).alias("conv"), F.col("conv_id").isNull().alias("none")]
    turns = rows.select(*ids, "turn").groupBy("conv", "none").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return every.select(*ids).distinct().join(turns, ["conv", "none"], "left").join(found, ["conv", "none"], "left").select(
        F.when(~F.col("none"), F.col("conv")).alias("conv_id"),
        *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
