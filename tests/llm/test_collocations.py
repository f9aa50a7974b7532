"""Collocations against plain Python: nulls, ties, overlaps, repeated rows and languages."""

import re
from collections import Counter

from driftloom.llm import collocations


def _mine(rows, least, share, top, max_n=3):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            totals[lang or "und"] += len(words)
            for n in range(1, max_n + 1):
                counts.update(((lang or "und"), tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    found = {}
    for (lang, words), a in counts.items():
        if len(words) < 2 or a < least:
            continue
        cuts = []
        for k in range(1, len(words)):
            l, r = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((10**6 * a * a // (l * r), k, l, r))
        found[lang, words] = (a, min(cuts))
    inner = lambda w, v: any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))
    out = set()
    for lang in totals:
        own = {w: v for (g, w), v in found.items() if g == lang}
        free = [(w, a, low) for w, (a, low) in own.items() if not any(len(v) > len(w) and inner(w, v) and 100 * b >= share * a for v, (b, _) in own.items())]
        free.sort(key=lambda x: (-x[2][0], -x[1], " ".join(x[0]).encode()))
        out |= {(lang, i + 1, " ".join(w), a, low[2], low[3], totals[lang], low[0], low[1]) for i, (w, a, low) in enumerate(free[:top])}
    return out


def _rows():
    said = ["New York city hall", "new  york\tcity", "the cat; the cat the cat the cat", "a a a a a a", "été Été ÉTÉ été", "x,y z.x y z", "", None, "  ", "nb sp one two"]
    out = [(t, "en") for t in said * 4] + [(t, None) for t in said * 2] + [(t, "und") for t in said] + [("a b c d e f g " * 300, "long")]
    return out + [("i j k" if i % 3 else "i j l", "share") for i in range(60)]


def _frame(spark, rows):
    return spark.createDataFrame([(i // 2, t, g, "p", 1) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, f int").repartition(3)


def test_equals_plain_python(spark):
    rows = _rows()
    docs = _frame(spark, rows)
    for least, share, top, max_n in ((2, 50, 2000, 3), (3, 90, 5, 3), (10, 50, 2000, 4)):
        got = [tuple(r) for r in collocations.mine(docs, least=least, share=share, top=top, max_n=max_n).collect()]
        assert len(got) == len(set(got))
        assert set(got) == _mine(rows, least, share, top, max_n)


def test_no_rows_and_no_words(spark):
    docs = _frame(spark, [(None, None), ("", "en"), (" \t.", "de")])
    assert collocations.mine(docs).collect() == []
    assert collocations.mine(docs.where("1 = 0")).collect() == []


def test_products_pass_64_bits(spark):
    counts = [("g", "p", 4_000_000_000), ("g", "q", 5_000_000_000), ("g", "p q", 3_999_999_999)]
    frame = spark.createDataFrame(counts, "lang string, phrase string, f long")
    a, l, r = 3_999_999_999, 4_000_000_000, 5_000_000_000
    got = collocations.scores(frame).collect()
    assert [(x.phrase, x.low.score, x.low.l, x.low.r) for x in got] == [("p q", 10**6 * a * a // (l * r), l, r)]
