"""Quality rules: a short-circuit cascade ordered by rejection per cost.

``profile`` computes the counts that the rules read, all with built-in expressions. ``plan_cascade`` runs every rule over
a bounded sample, measures its cost and the share that it rejects, and orders the rules by rejection per cost.
``judge`` folds the ordered rules into one CASE, whose later branches are not evaluated once an earlier one rejects.
The verdict is the conjunction of all rules, so it does not depend on the order; only the work does.

Defined cases: rows with null keys are rows like others; null, empty and blank texts have zero words and fail the base; a text with fewer than three words has no
window; equal rows get equal verdicts; an empty table gives an empty result and the rules' given order; extra columns,
whatever their names, do not matter, as only the key and text columns are read.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

#: Rows that the cost and selectivity estimates read at most, about.
SAMPLE_ROWS = 1000
#: Evaluations of each sampled row, so that a rule's own time outweighs that of starting a job.
REPEATS = 4
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a SQL condition over the profile's columns and ``text``."""

    name: str
    rejects: str


#: The counts are whole numbers, so every condition is exact.
RULES = (
    Rule("many_symbols", "10 * n_symbols > 3 * n_words"),
    Rule("long_words", "word_chars > 14 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("duplicate_lines", "n_dup_lines > 4 and 2 * n_dup_lines > length(text) - length(replace(text, '\\n', ''))"),
    Rule("few_letters", "2 * (length(text) - length(regexp_replace(text, '\\\\p{L}+', ''))) < word_chars"),
    Rule("shouting", "2 * (length(text) - length(regexp_replace(text, '\\\\p{Lu}+', ''))) > word_chars"),
    Rule("exclamations", "10 * (length(text) - length(replace(text, '!', ''))) > 4 * n_words"),
)


def _windows(w: Column) -> Column:
    """A 64-bit hash of each three-word window."""
    return F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(
        let(
            w,
            lambda v: F.transform(
                F.sequence(F.lit(0), F.size(v) - 3),
                lambda i: F.xxhash64(F.get(v, i), F.get(v, i + 1), F.get(v, i + 2)),
            ),
        )
    )


#: Low bits of a sort key that hold a window's place; longer texts take the plain sort.
PLACE_BITS = 20


def _spread(places: Column) -> Column:
    """Words that windows of three words at these sorted places cover."""
    gaps = let(
        places, lambda p: F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
    )
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)


def _plainly(hashes: Column) -> Column:
    """Places of repeated windows by sorting whole (hash, place) pairs."""
    ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    same = lambda s, x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
    return F.sort_array(
        let(ranked, lambda s: F.array_compact(F.transform(s, lambda x, i: F.when(same(s, x, i), x["i"]))))
    )


def profile(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, ``text`` and the base counts, one row for each row of ``docs``. No shuffle.

    Windows are compared by a 64-bit hash of their three words, within a text only. Texts without any repeated hash (the
    usual case) end there. Otherwise the hash's upper bits and the window's place are sorted as one number; two unequal
    hashes with equal upper bits send the text to the sort of whole pairs, as does a text of over a million windows.
    The work is split into projections because built-in array functions are compiled only outside lambdas.
    """
    top = lambda x: F.shiftright(x, PLACE_BITS)
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    body = F.coalesce(F.col(text), F.lit(""))
    counted = docs.select(
        F.col(key).alias("_key"),
        body.alias("text"),
        words(body).alias("_w"),
        (F.length(body) - F.length(F.regexp_replace(body, f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    kept = ["_key", "text", "n_symbols"]
    hashed = counted.select(
        *kept,
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_w").cast("long").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _windows(F.col("_w")).alias("_h"),
    )
    kept += ["word_chars", "n_words", "n_dup_lines"]
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    keyed = F.transform("_h", lambda x, i: F.shiftleft(top(x), PLACE_BITS).bitwiseOR(i.cast("long")))
    ranked = hashed.select(
        *kept,
        F.when(repeats, F.col("_h")).alias("_h"),
        F.when(repeats & (F.col("n_words") < 1 << PLACE_BITS), F.sort_array(keyed)).alias("_s"),
    )
    same = lambda s, x, i: (top(x) == top(F.get(s, i - 1))) | (top(x) == top(F.get(s, i + 1)))
    found = ranked.select(
        *kept,
        "_h",
        F.when(
            F.col("_s").isNotNull(),
            let(F.col("_s"), lambda s: F.array_compact(F.transform(s, lambda x, i: F.when(same(s, x, i), x)))),
        ).alias("_d"),
    )
    mixed = let(
        F.struct("_d", "_h"),
        lambda v: F.exists(
            F.sequence(F.lit(1), F.greatest(F.size(v["_d"]) - 1, F.lit(1))),
            lambda i: (top(F.get(v["_d"], i)) == top(F.get(v["_d"], i - 1)))
            & (F.get(v["_h"], place(F.get(v["_d"], i)).cast("int")) != F.get(v["_h"], place(F.get(v["_d"], i - 1)).cast("int"))),
        ),
    )
    places = F.when(F.col("_d").isNull() | F.coalesce(mixed, F.lit(False)), _plainly(F.col("_h"))).otherwise(
        F.sort_array(F.transform("_d", place))
    )
    return (
        found.select(*kept, F.when(F.col("_h").isNotNull(), places).alias("_p"))
        .withColumn("n_repeat_words", F.coalesce(_spread(F.col("_p")), F.lit(0).cast("long")))
        .select(F.col("_key").alias(key), "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def plan_cascade(
    docs: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS
) -> list[tuple[Rule, float, float]]:
    """The rules with their measured cost (seconds a row) and rejected share, best rejection per cost first.

    The sample is taken by a hash of the row's key and text, about ``sample_rows`` rows of any input. A rule is evaluated
    ``REPEATS`` times for each of its rows inside one aggregate, the faster of two runs counts, and an empty aggregate's time goes
    off. What is left below that one's own spread cannot be told from nothing and costs as much as the spread, so
    such rules go by what they reject. Ties keep the given order.
    """
    total = docs.count()
    if not total:
        return [(r, 0.0, 0.0) for r in rules]
    keep = max(1, total // sample_rows)
    sample = profile(docs.where(F.pmod(F.xxhash64(key, text), F.lit(keep)) == 0), key, text).persist()
    again = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def timed(condition: Column) -> tuple[float, int, int]:
        began = time.perf_counter()
        row = again.agg(F.count("*").alias("n"), F.count_if(condition).alias("hits")).first()
        return time.perf_counter() - began, row.n, row.hits

    timed(F.lit(True))
    empty = [timed(F.col("n_words") < 0) for _ in range(3)]
    floor, n = min(t for t, _, _ in empty), max(empty[0][1], 1)
    spread = max(max(t for t, _, _ in empty) - floor, 0.01)
    found = []
    for rule in rules:
        took, _, hits = min(timed(F.expr(rule.rejects)) for _ in range(2))
        found.append((rule, max(took - floor, spread) / n, hits / n))
    sample.unpersist()
    return by_worth(found)


def by_worth(measured: list[tuple[Rule, float, float]]) -> list[tuple[Rule, float, float]]:
    """Rules with cost and rejected share, most rejection per cost first; ties keep their order."""
    return sorted(measured, key=lambda x: -x[2] / x[1] if x[1] else 0.0)


def judge(profiled: DataFrame, ordered: Sequence[Rule]) -> DataFrame:
    """Adds ``base_failed`` and ``kept``. Rules run in order and stop at the first rejection."""
    verdict = F.when(base_failed(), False)
    for rule in ordered:
        verdict = verdict.when(F.expr(rule.rejects), False)
    return profiled.withColumns({"base_failed": base_failed(), "kept": verdict.otherwise(True)})


def quality(docs: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, text, counts, ``base_failed`` and ``kept``."""
    ordered = [r for r, _, _ in plan_cascade(docs, rules, key, text)]
    return judge(profile(docs, key, text), ordered)


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that pass, with their own columns. Works row by row, without a join back.

    The place column keeps the filter above the counts: pushed below them, it would compute each count once for every
    time that a rule names it.
    """
    ordered = [r for r, _, _ in plan_cascade(docs, rules, key, text)]
    packed = docs.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    body = F.coalesce(F.col("_text"), F.lit(""))
    carried = profile(packed.select(F.struct("_row", "_key").alias("_both"), body.alias("_text")), "_both", "_text")
    judged = judge(carried, ordered).withColumn("_place", F.monotonically_increasing_id())
    return judged.where("kept and _place >= 0").select("_both._row.*")


ORACLE = r"""
with w as (
  select doc_id, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
pos as (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 3),
win as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i+1], w[i+2]) as c from pos),
cov as (select doc_id, count(distinct j) as n from (
          select doc_id, unnest([i, i+1, i+2]) as j from win where c >= 2) group by doc_id),
lines as (select doc_id, count(*) - count(distinct l) as n from (
          select doc_id, unnest(string_split(text, chr(10))) as l from w)
          where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id),
base as (
  select w.doc_id, text, len(w)::bigint as n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         coalesce(lines.n, 0)::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words
  from w left join cov using (doc_id) left join lines using (doc_id)),
judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed
         or 10 * n_symbols > 3 * n_words or word_chars > 14 * n_words or word_chars < 2 * n_words
         or (n_dup_lines > 4 and 2 * n_dup_lines > length(text) - length(replace(text, chr(10), '')))
         or 2 * length(regexp_replace(text, '[^\p{L}]', '', 'g')) < word_chars
         or 2 * length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) > word_chars
         or 10 * length(regexp_replace(text, '[^!]', '', 'g')) > 4 * n_words) as kept
from judged
"""
