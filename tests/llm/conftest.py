import random

import pytest

EXTRA = "key string, hash string, slot int, row int, kept boolean"


def _texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = make(60), make(300)
    near = base.split()
    near[150] = "changed"
    long = "\n".join(make(40) for _ in range(120))
    mail = "write to a.b@c.example.com or x@y.z..foo@bar.com from 10.0.0.1, 999.1.1.1, +1 (017) 555-7713 or 4111 1111 1111 1111"
    return [
        None, "", "   \n\t", "one", "one two three", base, base, " ".join(near), base + " " + passage, make(80) + " " + passage, long,
        "a " * 200, mail, "### \\ </turn> \\h", "Ünïcode \U0001d11e " * 30, "x" * 50, "x" * 50, "x" * 70, make(120), make(5), "line\nline\nline\nother",
        "1." * 300, "1" * 500, make(2000), make(2000).upper(), "$$$ %%% " * 60, "It's 3 o'clock, isn't it? <|endoftext|> 'S",
    ]


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls, empty and long texts, ties, a repeated row and extra columns with awkward names."""
    rows = [(i * 3, t, "en", None if i % 5 == 0 else f"s{i % 4}", len(t or ""), "k", "h", 1, 2, True) for i, t in enumerate(_texts())]
    rows.append(rows[5])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("1 = 0")


@pytest.fixture(scope="session")
def plain(docs):
    return sorted((r.doc_id, r.text or "", r.source) for r in docs.collect())
