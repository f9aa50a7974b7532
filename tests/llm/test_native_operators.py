import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from driftloom.llm import boosting, chat, mixing, pii, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _profile(text):
    w = WORD.findall(text)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_base(docs, plain, empty):
    got = sorted(tuple(r) for r in quality.quality(docs).drop("text").collect())
    assert [r[:6] for r in got] == sorted((k, *_profile(t)) for k, t, _ in plain)
    for _, n, _, _, _, rep, failed, kept in got:
        assert failed == (n < 50 or 100 * rep > 50 * n)
        assert not (failed and kept)
    assert quality.quality(empty).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r[7] for r in got) > 0


def test_repeated_windows_by_the_plain_sort(spark):
    rows = spark.createDataFrame([([3, 1, 3, 2, 1],)], "h array<long>").select(quality._plainly(F.col("h")).alias("p"))
    assert rows.first().p == [0, 1, 2, 4]


def test_order_of_rules_does_not_change_the_verdict(docs):
    a = quality.judge(quality.profile(docs), quality.RULES).select("doc_id", "kept").collect()
    b = quality.judge(quality.profile(docs), quality.RULES[::-1]).select("doc_id", "kept").collect()
    assert sorted(a) == sorted(b)


def test_mixing_meets_targets(docs, plain, empty):
    got = mixing.schedule(docs).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for _, t, s in plain:
        sizes[s] += len(WORD.findall(t))
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
        target[r.source] = r.target
    order = sorted(x for x in sizes if x is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, want, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] <= level * weight[s]}
        for s in full or open_:
            want[s] = 2 * sizes[s] if full else level * weight[s]
        left -= sum(want[s] for s in full)
        open_ = open_ - full if full else set()
    for s in order:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 1
    again = mixing.schedule(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(WORD.findall(r.text or ""))
    assert words == +taken
    assert mixing.schedule(empty).count() == 0 and mixing.mix(empty).count() == 0


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _base(text):
    out = []
    for kind, rx in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(rx, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and _luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data(docs, plain, empty):
    detector = pii.fit(docs)
    got = sorted(pii.digest(pii.detect(docs, detector)).collect())
    for (key, text, _), r in zip(plain, got, strict=True):
        base = _base(text)
        assert r.doc_id == key and r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(","))
        assert r.n_email == sum(b.startswith("email") for b in base)
    clean = pii.redact(docs, detector)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    text = clean.where("text like 'write%'").first().text
    assert "@" not in text and "10.0.0.1" not in text and "[EMAIL]" in text
    assert pii.detect(empty).count() == 0


def test_boosting_learns_and_calibrates():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.3)).astype(float)
    model = boosting.fit(x[:1000], y[:1000])
    score = model.scores(x[1000:])
    assert ((score > 0) == (y[1000:] > 0)).mean() > 0.95
    at = boosting.calibrate(score, y[1000:], 0.95)
    assert y[1000:][score >= at].mean() >= 0.95
    assert boosting.calibrate(np.zeros(0), np.zeros(0), 0.9) == float("inf")


def test_chat_round_trip(spark):
    said = ["", "### user: x </turn>\n", "\\s \\\\h ###### </turn></turn>", "\\", None, "plain é"]
    rows = [(c, t, ("user", "assistant", "a:b\n", None)[(t + c) % 4], said[(t * 3 + c) % 6], "x") for c in range(4) for t in range(7)]
    rows += [rows[0], (9, 0, "assistant", None, "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string")
    parsed = chat.parse(chat.render(chat.fold(table)))
    want = defaultdict(list)
    for c, t, r, x, _ in sorted(rows, key=lambda v: (v[0], v[1], v[2] or "", v[3] or "")):
        want[c].append((r or "", x or ""))
    got = parsed.collect()
    assert len(got) == len(want)
    for r in got:
        assert [tuple(t) for t in r.turns] == want[r.conv_id]
        assert r.loss == [x for who, x in want[r.conv_id] if who == "assistant"]
    assert chat.digest(chat.parse(chat.render(chat.fold(table.where("1 = 0"))))).count() == 0


def test_chat_folds_events(spark):
    log = [
        (1, 1, "message", None, "user", "hi"), (1, 2, "message", None, "assistant", "he"), (1, 3, "delta", None, "assistant", "llo"),
        (1, 4, "regenerate", None, "assistant", "good"), (1, 5, "delta", None, "assistant", " day"), (1, 6, "edit", 1, "user", "hello"),
        (2, 1, "delta", None, "assistant", "a"), (2, 2, "edit", None, "assistant", "b"), (2, 3, "delta", None, "assistant", "c"),
    ]
    events = spark.createDataFrame(log, "c long, n long, kind string, target long, role string, text string")
    got = {(r.conv, r.seq): r.text for r in chat.fold(events, "c", "n", "role", "text", "kind", "target").collect()}
    assert got == {(1, 1): "hello", (1, 4): "good day", (2, 1): "bc"}
