"""Conversation repair against plain Python: every edit string's cost by recursion, long conversations cut into pieces."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from driftloom.llm import repair as rp

SPACES = " \t\n\x0b\x0c\r"


def _damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def _cheapest(rows):
    """Least (cost, edits) of a conversation's (initial, fault) rows."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @cache
    def best(t, state, inserted):
        found = []
        if t == len(rows) and state in ("", "a"):
            found.append((0, ""))
        if inserted < 3:
            for role in "ua":
                if (state, role) in after:
                    cost, edits = best(t, role, inserted + 1)
                    found.append((cost + 5, "I" + edits))
        if t < len(rows):
            initial, fault = rows[t]
            cost, edits = best(t + 1, state, 0)
            found.append((cost + 2, "D" + edits))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if (state, initial) in after:
                    cost, edits = best(t + 1, initial, 0)
                    found.append((cost + more, "K" + edits))
                for role in "ua":
                    if (state, role) in after:
                        cost, edits = best(t + 1, role, 0)
                        found.append((cost + more + 1, "R" + edits))
        return min(found, default=(10**9, ""))

    for t in range(len(rows), -1, -1):
        for state in ("", "s", "u", "a"):
            best(t, state, 0)
    return best(0, "", 0)


def _plain(rows):
    out = set()
    damaged = _damaged(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faults = set(), []
        for _, _, role, text in own:
            last = text.rstrip(SPACES)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
            seen.add((role, text))
        cost, edits = _cheapest(tuple((r[2][:1], f) for r, f in zip(own, faults, strict=True)))
        said, at, state = [], 0, ""
        for letter in edits:
            role = own[at][2] if letter == "K" else {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
            if letter != "D":
                said.append(role + ":" + ("" if letter == "I" else own[at][3]))
                state = role[:1]
            at += letter != "I"
        assert re.fullmatch("(s?(ua)+)?", "".join(s[0] for s in said)) and at == len(own)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [own[i][2][:1] + own[i + 1][2][:1] for i in range(len(own) - 1)]
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        digest = hashlib.sha256("\n".join(said).encode()).hexdigest()
        out.add((conv, gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, edits, digest))
    return out


def _rows():
    rng, rows = random.Random(11), []
    words = ["yes.", "no", "why?", "ok!", "done. ", "\n", "", None, "and then", "été.", "a. b"]
    roles = ["user", "assistant"] * 4 + ["system", "tool", None, ""]
    for conv in [*range(60), None, 2**40]:
        rows += [(conv, t, rng.choice(roles), f"{rng.choice(words) or ''}" if rng.random() < 0.2 else f"{t} {rng.choice(words)}") for t in range(rng.randint(1, 9))]
    rows += [(7, None, "user", "no turn."), (7, None, None, None), (7, 3, "user", "tie"), (7, 3, "assistant", "tie"), (8, None, "user", "x"), (8, -5, "user", "y.")]
    rows += [(9, t, ["user", "assistant"][t % 2], f"said {t % 97}.") for t in range(700)]
    rows += [(10, t, rng.choice(roles), rng.choice(words)) for t in range(500)]
    rows += [rows[0], rows[5], rows[5]]
    rng.shuffle(rows)
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, whole int").repartition(4)


@pytest.mark.parametrize("most", [3, 64, rp.PIECE])
def test_equals_plain_python(spark, most):
    rows = _rows()
    frame = _frame(spark, rows)
    damaged = rp.damage(frame)
    got = rp.digest(rp.repair(damaged, most=most), damaged, frame)
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got.columns == columns
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found))
    assert set(found) == _plain(rows)


def test_empty_and_all_dropped(spark):
    frame = _frame(spark, _rows())
    none = frame.where("1 = 0")
    assert rp.digest(rp.repair(rp.damage(none)), rp.damage(none), none).collect() == []
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    gone = _frame(spark, [(conv, 0, "user", "hi.")])
    damaged = rp.damage(gone)
    got = rp.digest(rp.repair(damaged), damaged, gone).collect()
    assert [tuple(r) for r in got] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_messages_are_the_repaired_conversation(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "tool", "Sure."), (1, 4, "user", "Bye.")]
    found = rp.repair(_frame(spark, rows)).collect()
    left = [("system", "Be kind."), ("user", "Hi."), ("assistant", "Bye.")]
    assert [(r.audit, r.cost, r.duplicate, [(m.role, m.text) for m in r.messages]) for r in found] == [("KKDDR", 5, 1, left)]
