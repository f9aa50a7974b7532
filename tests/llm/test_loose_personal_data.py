"""Loose forms of personal data that stand alone are redacted, clean lookalikes are not."""

import random

from driftloom.llm import pii

LOOSE = {
    "email": ["write to jane.roe (at) example (dot) org today", "mail jane.roe[at]example.org, please", "she is jane at example dot org now"],
    "ip": ["host 2001:db8:85a3:8d3:1319:8a2e:370:7348 is up"],
    "card": ["paid with 4111.1111.1111.1111 then", "paid with 5500/0000/0000/0004 then"],
    "phone": ["call (743) 555-3824 now", "call 743-555-3824 now", "ring 00 1 743 555 3824 now"],
}
CLEAN = [
    "on 2024-01-15 we met", "on 15.01.2024 we met", "number 48213377 is drawn", "paid with 4111.1111.1111.1112 then", "made 12 000 000 of them",
    "laps 10:20:30:40:50:51:07:08 were run", "arrived at 10.30 and left", "stayed at home.Then we left", "address 999.10.10.10 is none", "no data here",
]


def _luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _docs(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeionrst") for _ in range(rng.randint(2, 8)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows = []
    for i in range(160):
        card = next(c for c in iter(lambda: "4" + number(15), None) if _luhn(c))
        real = [
            f"{word()}.{word()}@{word()}.example.com", ".".join(str(rng.randint(1, 255)) for _ in range(4)), card, f"+1 ({rng.randint(200, 999)}) 555-{number(4)}",
        ]
        rows.append((i, f"{word()} {word()} {real[i % 4]} {word()} {word()}"))
    rows += [(1000 + i, t) for i, t in enumerate(t for kind in LOOSE for t in LOOSE[kind])]
    rows += [(2000 + i, t) for i, t in enumerate(CLEAN)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_loose_forms_and_lookalikes(spark):
    docs = _docs(spark)
    got = {r.doc_id: r.text for r in pii.redact(docs).where("doc_id >= 1000").collect()}
    want = [(kind, t) for kind in LOOSE for t in LOOSE[kind]]
    assert [f"[{kind.upper()}]" in got[1000 + i] for i, (kind, _) in enumerate(want)] == [True] * len(want), got
    assert [got[2000 + i] for i in range(len(CLEAN))] == CLEAN
