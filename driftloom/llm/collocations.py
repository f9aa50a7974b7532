"""Phrase collocations: word sequences that occur together more often than their parts suggest, per language.

All 1 to ``max_n`` word sequences of every text become rows, which one hash aggregate counts per language. Equal rows of
``TOGETHER`` bytes of text leave their task as one row with a count (words are told apart by 64-bit hashes there), so a
frequent phrase or a language with most rows doesn't gather in a task. From then on only phrases of at least ``least``
occurrences matter (the parts of such a phrase are as frequent), so the rest works on that small table: it is cut behind
each word and joined with the counts of both parts, scored in exact decimals, freed from phrases that mostly occur inside
a one-word extension (an anti join), and ranked per language by a window, in shares of each language first.

An extension by several words needs no look: the one-word extension inside it is at least as frequent.

Defined cases: a null text has no words, a null language is ``und``, equal to a language of that name; repeated rows count
as often as they occur; an empty table gives an empty result; ties in score and count are ordered by the phrase's bytes.
Extra columns don't matter. A very long text is worked off in its own step of a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import batch, released, runs, text_chunks, word_hashes
from .common import checkpointed

#: Lower case for A to Z; blanks become a space and what ends a piece a line end. No phrase crosses a piece's end.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)
#: Scores are in millionths.
SCALE = 1_000_000
WHOLE = "decimal(19,0)"
#: Bytes of text whose equal phrases leave a task as one row.
TOGETHER = 20 << 20
#: Shares of a language that are ranked on their own first.
SHARES = 64
#: Rows that leave a task together.
BATCH = 100_000
_ROW = [("lang", pa.string()), ("phrase", pa.string()), ("times", pa.int32())]


def _joined(words: Column, start: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def _phrases(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges of ``raw`` as strings."""
    lengths = ends - starts
    edges = np.r_[0, np.cumsum(lengths)]
    places = np.repeat(starts - edges[:-1], lengths) + np.arange(edges[-1])
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(raw[places])])


def _counted(whole: bytes, max_n: int) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """Phrases of one chunk of translated text, each once: their words, the phrases, their counts."""
    data = np.frombuffer(whole, np.uint8)
    word = (data != 32) & (data != 10)
    before = np.r_[False, word[:-1]] if len(word) else word
    starts, hashes = word_hashes(whole, lower=False)
    piece = np.cumsum(data == 10, dtype=np.int32)[starts]
    # each word and one space, so that a phrase is a range of bytes
    raw = np.where(word, data, np.uint8(32))[word | before]
    ends = np.flatnonzero(np.r_[raw == 32, not len(raw) or raw[-1] != 32])[: len(starts)]
    starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    del data, word, before
    if not len(starts):
        return
    # words become ranks in the order of their bytes, so that equal phrases meet and neighbours share their beginning
    _, first, own = np.unique(hashes, return_index=True, return_inverse=True)
    said = [raw[a:z].tobytes() for a, z in zip(starts[first], ends[first], strict=True)]
    rank = np.empty(len(said), np.int32)
    rank[sorted(range(len(said)), key=said.__getitem__)] = np.arange(len(said))
    words, word_rank = len(said), rank[own]
    del hashes, own, said, rank
    code, inside = word_rank, np.arange(len(starts), dtype=np.int32)
    for n in range(1, max_n + 1):
        if n > 1:
            kept = inside + n - 1 < len(piece)
            kept[kept] = piece[inside[kept]] == piece[inside[kept] + n - 1]
            inside = inside[kept]
            code = code[kept].astype(np.int64) * words + word_rank[inside + n - 1]
            del kept
        order = np.argsort(code)
        first, times = runs(code[order])
        at = inside[order[first]]
        code = np.empty(len(order), np.int32)
        code[order] = np.repeat(np.arange(len(first), dtype=np.int32), times)  # ranks of phrases, small enough to be extended
        del order
        for k in range(0, len(at), BATCH):
            own = at[k : k + BATCH]
            yield n, _phrases(raw, starts[own], ends[own + n - 1]), times[k : k + BATCH]


def _exploded(max_n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, most=TOGETHER):
            langs = part["lang"].to_pylist()
            for lang in sorted(set(langs)):
                whole = b"\n".join(t for t, own in zip(texts, langs, strict=True) if own == lang).translate(_PLAIN)
                total = 0
                for n, phrases, times in _counted(whole, max_n):
                    total += int(times.sum()) * (n == 1)
                    yield batch(_ROW, [pa.repeat(lang, len(phrases)), phrases, times])
                yield batch(_ROW, [[lang], [""], [total]])

    return run


def phrase_counts(docs: DataFrame, text: str, lang: str, max_n: int, least: int) -> DataFrame:
    """Phrases of 1 to ``max_n`` words that occur ``least`` times or more: lang, phrase, f; the empty phrase's f counts a language's words."""
    slim = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    rows = slim.mapInArrow(released(_exploded(max_n)), "lang string, phrase string, times int")
    # one key column makes smaller rows; phrases have no tab. Most rows of a task differ by now, so they are dealt as they are
    dealt = rows.select(F.concat("lang", F.lit("\t"), "phrase").alias("both"), "times").repartition("both")
    counted = dealt.groupBy("both").agg(F.sum("times").alias("f"))
    counted = counted.where((F.col("f") >= least) | F.endswith("both", F.lit("\t")))
    phrase = F.substring_index("both", "\t", -1)
    return counted.select(F.substr("both", F.lit(1), F.length("both") - F.length(phrase) - 1).alias("lang"), phrase.alias("phrase"), "f")


def _candidates(frequent: DataFrame) -> DataFrame:
    return frequent.where(F.contains("phrase", F.lit(" "))).select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))


def scores(frequent: DataFrame) -> DataFrame:
    """Candidates with their lowest-scoring cut: lang, phrase, a, low (score, cut, l, r)."""
    n = F.size("words")
    cuts = _candidates(frequent).select("*", F.explode(F.sequence(F.lit(1), n - 1)).alias("cut"))
    sides = cuts.withColumns({"first": _joined(F.col("words"), 1, F.col("cut")), "rest": _joined(F.col("words"), F.col("cut") + 1, n - F.col("cut"))})
    part = lambda name, count: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    exact = lambda c: F.col(c).cast(WHOLE)
    return (
        sides.drop("words")
        .join(part("first", "l"), ["lang", "first"])
        .join(part("rest", "r"), ["lang", "rest"])
        .withColumns({"above": exact("a") * exact("a") * F.lit(SCALE), "below": exact("l") * exact("r")})
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct(F.expr("above div below").alias("score"), "cut", "l", "r")).alias("low"))
    )


def mine(
    docs: DataFrame, text: str = "text", lang: str = "lang", max_n: int = 3, least: int = 10, share: int = 50, top: int = 2000
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score, cut (words before the lowest-scoring cut).

    ``least``: occurrences that make a candidate. ``share``: percentage of a candidate's occurrences inside a longer one from
    which it is dropped.
    """
    frequent = checkpointed(phrase_counts(docs, text, lang, max_n, least))
    candidates, scored, n = _candidates(frequent), scores(frequent), F.size("words")
    longer = candidates.where(n > 2).select(
        "lang", F.col("a").alias("f"), F.explode(F.array(_joined(F.col("words"), 1, n - 1), _joined(F.col("words"), 2, n - 1))).alias("phrase")
    )
    inside = longer.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    held = (F.col("c.lang") == F.col("x.lang")) & (F.col("c.phrase") == F.col("x.phrase")) & (100 * F.col("x.f") >= share * F.col("c.a"))
    free = scored.alias("c").join(inside.alias("x"), held, "left_anti")
    within = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("low.score"), F.desc("a"), "phrase"))
    # a language's first are among the first of its shares, so no task ranks a whole language
    dealt = free.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    few = dealt.withColumn("rank", within("lang", "share")).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", within("lang")).where(F.col("rank") <= top)
    totals = frequent.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "low.l", "low.r", "n", "low.score", F.col("low.cut").cast("long").alias("cut")
    )


ORACLE = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, list_filter(regexp_split_to_array(piece, '[ \x09]+'), lambda x: x <> '') as w from p),
g as (select lang, unnest(w) as phrase from w
  union all select lang, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ' '))) from w
  union all select lang, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) from w),
f as materialized (select lang, phrase, count(*) as f from g group by 1, 2 having count(*) >= 10),
n as (select lang, sum(len(w))::bigint as n from w group by 1 having sum(len(w)) > 0),
c as (select lang, phrase, f as a, string_split(phrase, ' ') as w from f where contains(phrase, ' ')),
e as (select lang, phrase, a, unnest(range(1, len(w))) as cut, w from c),
k as materialized (select lang, phrase, a, cut, array_to_string(w[1:cut], ' ') as left_part, array_to_string(w[cut+1:], ' ') as right_part from e),
s as (select k.lang, k.phrase, k.a, k.cut, x.f as l, y.f as r, ((1000000::hugeint * k.a * k.a) // (x.f::hugeint * y.f))::bigint as score
  from k join f x on x.lang = k.lang and x.phrase = k.left_part
  join f y on y.lang = k.lang and y.phrase = k.right_part),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
x as (select lang, phrase, max(a) as a from (
  select lang, array_to_string(w[1:len(w)-1], ' ') as phrase, a from c where len(w) > 2
  union all select lang, array_to_string(w[2:], ' '), a from c where len(w) > 2) group by 1, 2)
select b.lang, row_number() over (partition by b.lang order by b.score desc, b.a desc, b.phrase) as rank, b.phrase, b.a, b.l, b.r, n.n, b.score, b.cut
from b join n on n.lang = b.lang left join x on x.lang = b.lang and x.phrase = b.phrase where x.a is null or 100 * x.a < 50 * b.a
qualify rank <= 2000
"""
