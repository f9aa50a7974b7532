"""Personal data: candidate spans, boosted trees over format and context, calibrated thresholds.

``candidates`` proposes spans with high recall: the base patterns and looser, overlapping ones. A base span that passes its
check stays whatever the model says. Every other candidate gets the boosted trees' score from its format (length, digits,
separators, check digit) and context (neighbouring characters, hint words) and is redacted from its kind's threshold up.
Features are measured behind a mask: what makes a pattern a base or a loose one (+, 00, @, at, dot, separators of cards) does
not show. The trees are fitted on a bounded sample: positive are the base spans that pass, rewritten into loose forms in
their own context (``_loosened``); negative are lookalikes in the same contexts (``_decoys``), base spans that fail, and the
loose candidates that meet no base span, unless these look like positives to a fit without them. Thresholds come from the held-out
half, without the base spans, which stay anyway.
Scoring is one expression inside the row: no shuffle, no join, no Python on the executors.

Patterns are written so that matching is linear: possessive loops do not recurse, and look-behinds keep a failed run from
being tried again from each of its characters.

Defined cases: null and empty texts have no spans; spans count code points, end exclusive; repeated rows get equal spans;
an empty table gives an empty result and a model that adds nothing. Extra columns do not matter.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import let

KINDS = ("email", "ip", "card", "phone")
#: Documents that are read for the training sample, about, and candidates that are collected at most.
SAMPLE_DOCS = 20_000
SAMPLE_CANDIDATES = 6_000
#: Base spans of each kind that are rewritten for the fit at most.
PLANTED = 150
PRECISION = 0.95

BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # only whole chains of 16 to 19 digits can pass, and chains never touch
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:\x20?[(\[]at[)\]]\x20?|\x20at\x20|\x20@\x20)[A-Za-z0-9-]{1,64}(?:(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,64}){1,4}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?:[0-9][\x20._/-]{0,2}){12,18}[0-9](?![0-9])",
    "phone": r"(?<![0-9])(?:00|\()?[0-9]{1,4}\)?(?:[\x20.-]?\(?[0-9]{2,5}\)?){2,4}(?![0-9])",
}
#: What every pattern above implies.
ANY = r"[0-9@]|\x20at\x20|[(\[]at[)\]]|(?:[0-9A-Fa-f]{1,4}:){7}"
#: A mail whose marks are spelled in a way that prose is not.
SPELLED = r"[(\[](?:at|dot)[)\]]|\x20dot\x20|\x20@\x20"
HINTS = r"(?i)(?:mail|tel|phone|call|fax|contact|card|visa|ip|addr|pay)[^\n]{0,12}$"
FEATURES = (
    "kind", "length", "digits", "letters", "spaces", "marks", "luhn", "domain", "wide", "dialled", "spelled",
    "before_space", "after_space", "before_word", "hint",
)
#: Share of the positives that a first fit may put below a loose candidate before that counts as one of them.
SPY = 0.1
_BLOCK = 512


def _before(a: Column, op: Callable[[Column, Column], Column]) -> Column:
    """``op`` over all items before each one (0 before the first), in blocks, so that long arrays stay cheap."""
    zero = F.lit(0).cast("long")

    def plain(x: Column) -> Column:
        start = F.struct(zero.alias("all"), F.array().cast("array<bigint>").alias("list"))
        step = lambda acc, v: F.struct(op(acc["all"], v).alias("all"), F.array_append(acc["list"], acc["all"]).alias("list"))
        return F.aggregate(x, start, step, lambda acc: acc["list"])

    def blocked(x: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(x) - 1) / _BLOCK).cast("int"))
        return let(F.transform(at, lambda b: F.slice(x, b * _BLOCK + 1, _BLOCK)), joined)

    def joined(blocks: Column) -> Column:
        wholes = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda s, v: op(s, v)))
        pairs = F.arrays_zip(blocks.alias("b"), plain(wholes).alias("o"))
        return F.flatten(F.transform(pairs, lambda z: F.transform(plain(z["b"]), lambda v: op(v, z["o"]))))

    return F.when(F.size(a) <= _BLOCK, plain(a)).otherwise(blocked(a))


def _running(a: Column) -> Column:
    return _before(a, lambda s, v: s + v)


def _reach(base: Column, place: Column) -> Column:
    """The furthest end of the base spans that start before ``place``, by bisection. ``base`` is what ``_ordered`` gives."""
    size = F.size(base["starts"])
    low_high = F.struct(F.lit(0).alias("low"), size.alias("high"))

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        less = F.get(base["starts"], mid) < place
        return F.when(acc["low"] >= acc["high"], acc).otherwise(
            F.struct(F.when(less, mid + 1).otherwise(acc["low"]).alias("low"), F.when(less, acc["high"]).otherwise(mid).alias("high"))
        )

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(size + F.lit(1))).cast("int"))
    found = F.aggregate(rounds, low_high, step, lambda acc: F.get(base["reach"], acc["low"]))
    return F.when(size == 0, F.lit(0).cast("long")).otherwise(found)


def _ordered(spans: Column) -> Column:
    """Starts in order, and before each place in that order (and after the last) the furthest end so far."""

    def split(x: Column) -> Column:
        ends = F.concat(F.transform(x, lambda s: s["end"]), F.array(F.lit(0).cast("long")))
        return F.struct(F.transform(x, lambda s: s["start"]).alias("starts"), let(ends, lambda e: _before(e, F.greatest)).alias("reach"))

    return let(F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))), split)


def _found(text: Column, pattern: str, kind: str, loose: bool) -> Column:
    """All leftmost non-overlapping matches: kind, loose, start, end, value, before, after."""

    def spans(v: Column) -> Column:
        lengths = F.zip_with(v["gaps"], v["hits"], lambda g, h: (F.length(g) + F.coalesce(F.length(h), F.lit(0))).cast("long"))
        return let(_running(lengths), lambda starts: F.transform(v["hits"], lambda h, i: span(v, starts, h, i)))

    def span(v: Column, starts: Column, hit: Column, i: Column) -> Column:
        gap = F.get(v["gaps"], i)
        start = F.get(starts, i) + F.length(gap)
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            F.lit(loose).alias("loose"),
            start.alias("start"),
            (start + F.length(hit)).alias("end"),
            hit.alias("value"),
            F.right(gap, F.lit(24)).alias("before"),
            F.substring(F.get(v["gaps"], i + 1), 1, 8).alias("after"),
        )

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.struct(hits.alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    none = F.array().cast("array<struct<kind:int,loose:boolean,start:bigint,end:bigint,value:string,before:string,after:string>>")
    # most texts have no match: one scan settles those
    return F.when(text.rlike(pattern), let(both, spans)).otherwise(none)


def _luhn(value: Column) -> Column:
    """Whether the value's digits pass the Luhn check."""
    digits = F.reverse(F.regexp_replace(value, r"[^0-9]", ""))

    def weigh(d: Column, i: Column) -> Column:
        n = d.cast("int") * F.when(i % 2 == 1, F.lit(2)).otherwise(F.lit(1))
        return n - F.when(n > 9, F.lit(9)).otherwise(F.lit(0))

    total = let(F.split(digits, "(?!$)"), lambda a: F.aggregate(F.transform(a, weigh), F.lit(0), lambda s, x: s + x))
    return (F.length(digits) > 0) & (total % 10 == 0)


def _passes(c: Column) -> Column:
    digits = F.length(F.regexp_replace(c["value"], r"[^0-9]", ""))
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
    return (
        F.when(c["loose"], False)
        .when(c["kind"] == 0, True)
        .when(c["kind"] == 1, c["value"].rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(c["kind"] == 2, _luhn(c["value"]))
        .otherwise(digits.between(8, 15))
    )


def _count(c: Column, pattern: str, rest: bool = False) -> Column:
    """Characters that a pattern takes, or those it leaves."""
    left = F.length(F.regexp_replace(c, pattern, ""))
    return (left if rest else F.length(c) - left).cast("double")


def _masked(c: Column) -> Column:
    """A candidate's value without the marks that tell base and loose patterns apart."""
    value = c["value"]
    mail = F.regexp_replace(value, r"\x20?[(\[]at[)\]]\x20?|\x20(?:at|@)\x20", "@")
    return (
        F.when(c["kind"] == 0, F.regexp_replace(mail, r"\x20?[(\[]dot[)\]]\x20?|\x20dot\x20", "."))
        .when(c["kind"] == 2, F.regexp_replace(value, r"[\x20._/-]+", ""))
        .when(c["kind"] == 3, F.regexp_replace(value, r"^(?:\+|00)", ""))
        .otherwise(value)
    )


def _measured(c: Column, base: Column) -> Column:
    """A candidate with its feature vector, whether a base check passes, and whether a base span holds it or meets it."""
    meets = _reach(base, c["end"]) > c["start"]
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    of = lambda kind, x: flag((c["kind"] != KINDS.index(kind)) | x)

    def vector(value: Column) -> Column:
        digits = _count(value, "[^0-9]+", rest=True)
        return F.array(
            c["kind"].cast("double"), F.length(value).cast("double"), digits, _count(value, r"\p{L}+"), _count(value, r"\x20+"),
            _count(value, r"[().:_/-]+"), of("card", _luhn(value)), of("email", value.rlike(r"\.[a-z]{2,}$|\.[A-Z]{2,}$")),
            of("ip", value.rlike("[0-9A-Fa-f]{3}")), of("phone", digits.between(8, 15)), flag(c["value"].rlike(SPELLED)),
            flag(c["before"].rlike(r"(?:^|\s)$")), flag(c["after"].rlike(r"^(?:$|\s|[.,;!?])")), flag(c["before"].rlike(r"[\p{L}\p{N}]$")),
            flag(c["before"].rlike(HINTS)),
        )

    inside = _reach(base, c["start"] + 1) >= c["end"]
    return F.struct(
        c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), let(_masked(c), vector).alias("x"),
        _passes(c).alias("sure"), inside.alias("inside"), meets.alias("meets"), c["loose"].alias("loose"), c["value"].alias("value"),
        c["before"].alias("before"), c["after"].alias("after"),
    )


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with their columns packed in ``row``, key, text and the candidates ``found``; base spans that fail go."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = F.concat(
        *[_found(F.col("_t"), BASE[k], k, False) for k in KINDS], *[_found(F.col("_t"), LOOSE[k], k, True) for k in KINDS]
    )
    bodies = docs.select(F.struct("*").alias("row"), F.col(key).alias("key"), body.alias("_t"))
    rows = bodies.select("row", "key", "_t", F.when(F.col("_t").rlike(ANY), found).alias("_found"))
    sure = F.filter("_found", lambda c: _passes(c))
    both = rows.select("row", "key", "_t", F.when(F.size("_found") > 0, F.struct(F.col("_found").alias("all"), _ordered(sure).alias("base"))).alias("_both"))
    measured = let(F.col("_both"), lambda v: F.transform(v["all"], lambda c: _measured(c, v["base"])))
    return both.select(
        "row",
        "key",
        F.col("_t").alias("text"),
        F.coalesce(F.when(F.col("_both").isNotNull(), measured), F.expr(
            "cast(array() as array<struct<kind:int,start:bigint,end:bigint,x:array<double>,sure:boolean,inside:boolean,meets:boolean,"
            "loose:boolean,value:string,before:string,after:string>>)"
        )).alias("found"),
    )


@dataclass(frozen=True)
class Detector:
    """The trees and the threshold of each kind."""

    models: tuple[boosting.Model, ...]
    thresholds: tuple[float, ...]

    def takes(self, c: Column) -> Column:
        """Whether a candidate is redacted."""
        likely = F.lit(False)
        for kind, (model, at) in enumerate(zip(self.models, self.thresholds, strict=True)):
            if at < float("inf"):
                likely = F.when(c["kind"] == kind, model.column(lambda j: F.get(c["x"], F.lit(j))) >= at).otherwise(likely)
        return F.when(c["sure"], True).when(c["inside"], False).otherwise(likely)


def _loosened(kind: int, value: str) -> list[str]:
    """Loose forms of a base span's value, long and short."""
    rng = random.Random(value)
    if kind == 0:
        name, host = value.split("@", 1)
        pairs = [(name, host.strip("-")), (name[: rng.randint(2, 8)].strip("."), ".".join(host.split(".")[-2:]))]
        forms = [("{} (at) {}", " (dot) "), ("{}[at]{}", "."), ("{} at {}", " dot "), ("{} @ {}", "."), ("{} (at) {}", ".")]
        return [form.format(n, h.replace(".", dot)) for n, h in pairs for form, dot in forms]
    if kind == 1:
        group = lambda: f"{rng.randrange(16 ** rng.randint(3, 4)):x}"
        starts = (["2001", "db8"], ["2001", "db8", "0", "0", "0", "0"], ["fe80", "0", "0", "0"], [])
        return [":".join([*start, *[group() for _ in range(8 - len(start))]]) for start in starts]
    digits = "".join(x for x in value if x.isdigit())
    if kind == 2:
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [mark.join(fours) for mark in (".", "/", "_", " - ")]
    groups = [x for x in "".join(x if x.isdigit() else " " for x in value).split(" ") if x]
    home = groups[1:] if len("".join(groups[1:])) >= 8 else groups
    forms = [mark.join(home) for mark in (" ", "-", ".")] + [" ".join([f"({home[0]})", "-".join(home[1:])])]
    return [*forms, f"00{' '.join(groups)}", f"0{' '.join(home)}"] if len(home) > 1 else [f"00{' '.join(groups)}"]


def _decoys(kind: int, value: str) -> list[str]:
    """Clean lookalikes of a base span's value: what loose patterns also match."""
    rng = random.Random(value)
    if kind == 0:
        name, host = value.split("@", 1)
        word = "".join(x for x in host if x.isalpha()).lower() or "home"
        words = [name, "met", word[: rng.randint(3, 8)]]
        times = [f"{w} at {rng.randrange(24)}.{rng.randrange(10, 60)}" for w in words]
        return [*times, *[f"{w} at {word[: rng.randint(3, 20)]}.{rng.choice(('Then', 'She', 'It', 'When'))}" for w in words]]
    if kind == 1:
        first, rest = value.split(".", 1)
        eight = lambda form, most: ":".join(form.format(rng.randrange(most)) for _ in range(8))
        return [eight("{:02d}", 60), eight("{:02x}", 256), eight("{:d}", 100), f"{int(first) + 300}.{rest}"]
    digits = "".join(x for x in value if x.isdigit())
    if kind == 2:
        wrong = digits[:-1] + str((int(digits[-1]) + rng.randint(1, 9)) % 10)
        fours = [wrong[i : i + 4] for i in range(0, len(wrong), 4)]
        return [mark.join(fours) for mark in (".", "/", "_", " - ")] + [wrong]
    year, month, day, hour, minute = rng.randint(1900, 2040), rng.randint(1, 12), rng.randint(1, 28), rng.randrange(24), rng.randrange(60)
    dates = [f"{year}-{month:02d}-{day:02d}", f"{day:02d}.{month:02d}.{year}", f"{year}-{month:02d}-{day:02d} {hour:02d}.{minute:02d}"]
    sums = [f"{rng.randint(1, 999)} {rng.randrange(1000):03d} {rng.randrange(1000):03d}", f"{rng.randint(300, 999)}.{rng.randint(10, 255)}.{rng.randint(10, 255)}.{rng.randint(10, 255)}"]
    return [*dates, *sums, digits, str(rng.randrange(10**4, 10 ** rng.randint(5, 12)))]


def _planted(spark: SparkSession, hits: list) -> list:
    """Loose forms (y 1) and lookalikes (y 0) of base spans in their contexts, as the generators propose them."""
    texts = [
        (r.h, r.kind, y, len(r.before), r.before + value + r.after, len(value))
        for r in hits
        for y, values in ((1.0, _loosened(r.kind, r.value)), (0.0, _decoys(r.kind, r.value)))
        for value in values
    ]
    if not texts:
        return []
    rows = spark.createDataFrame(texts, "h long, kind int, y double, low int, text string, size int")
    found = candidates(rows, "h", "text").select("row", F.explode("found").alias("c")).where("c.start < row.low + row.size and c.end > row.low and not c.sure")
    # a form is what its own kind's pattern makes of exactly it; all else that lies in a lookalike is none
    exact = F.expr("c.kind = row.kind and c.start = row.low and c.end = row.low + row.size")
    within = F.expr("c.start >= row.low and c.end <= row.low + row.size")
    return found.where(F.when(F.col("row.y") == 1, exact).otherwise(within)).select("row.h", "c.x", "row.y").collect()


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Detector:
    """Fits and calibrates on at most ``SAMPLE_CANDIDATES`` candidates of about ``SAMPLE_DOCS`` documents.

    No label depends on whether a candidate is loose. Documents go to fitting or to calibration by a hash of their key.
    """
    total = docs.count()
    keep = max(1, total // SAMPLE_DOCS)
    some = docs.where(F.pmod(F.xxhash64(key), F.lit(keep)) == 0)
    rows = (
        candidates(some, key, text)
        .select(F.xxhash64("key").alias("h"), F.explode("found").alias("c"))
        .select("h", "c.x", "c.sure", "c.meets", "c.loose", "c.value", "c.before", "c.after", "c.start", "c.kind")
        .orderBy(F.xxhash64("h", "start", "kind"))
        .limit(SAMPLE_CANDIDATES)
        .collect()
    )
    hits = [r for r in rows if r.sure]
    planted = _planted(docs.sparkSession, [r for k in range(len(KINDS)) for r in [h for h in hits if h.kind == k][:PLANTED]])
    failed = [r for r in rows if not r.sure and not r.meets]
    x = boosting.as_matrix([r.x for r in planted] + [r.x for r in failed], len(FEATURES))
    y = np.array([r.y for r in planted] + [0.0] * len(failed))
    held = np.array([(r.h >> 8) % 2 == 1 for r in [*planted, *failed]], dtype=bool)
    wild = np.array([False] * len(planted) + [r.loose for r in failed], dtype=bool)
    models, limits = zip(*(_fitted(x[own], y[own], held[own], wild[own]) for own in (x[:, 0] == k for k in range(len(KINDS)))), strict=True)
    return Detector(models, limits)


def _fitted(x: np.ndarray, y: np.ndarray, held: np.ndarray, wild: np.ndarray) -> tuple[boosting.Model, float]:
    """Trees of one kind and their threshold. ``wild`` rows are found loose candidates, negative for want of a better label."""
    if (y == 1).any():
        # loose candidates that look like positives are no negatives: nothing says that they are not personal data
        first = boosting.fit(x[~held & ~wild], y[~held & ~wild]).scores(x)
        sound = ~wild | (first < np.quantile(first[y == 1], SPY))
        x, y, held = x[sound], y[sound], held[sound]
    model = boosting.fit(x[~held], y[~held])
    # nothing less likely than not is redacted, however few negatives are held out
    return model, max(0.0, boosting.calibrate(model.scores(x[held]), y[held], PRECISION))


def detect(docs: DataFrame, detector: Detector | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: row, key, text, base and spans (kind, start, end), each sorted and without repeats."""
    detector = detector or fit(docs, key, text)
    short = lambda a: F.sort_array(F.array_distinct(F.transform(a, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))))
    return candidates(docs, key, text).select(
        "row",
        "key",
        "text",
        short(F.filter("found", lambda c: c["sure"])).alias("base"),
        short(F.filter("found", detector.takes)).alias("spans"),
    )


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, detector: Detector | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their own columns; each run of overlapping spans becomes ``[KIND]`` of its first span."""
    found = detect(docs, detector, key, text)
    by_place = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def rewritten(v: Column) -> Column:
        ends = F.concat(F.transform(v["spans"], lambda s: s["end"]), F.array(F.lit(0).cast("long")))
        return let(_before(ends, F.greatest), lambda reach: pasted(v, reach))

    def pasted(v: Column, reach: Column) -> Column:
        cut = lambda a, z: F.array_join(F.slice(v["chars"], (a + 1).cast("int"), F.greatest(z - a, F.lit(0)).cast("int")), "")
        piece = lambda s, i: F.when(s["start"] < F.get(reach, i), "").otherwise(
            F.concat(cut(F.get(reach, i), s["start"]), F.get(names, s["kind"]))
        )
        return F.concat(
            F.array_join(F.transform(v["spans"], piece), ""), cut(F.get(reach, F.size(v["spans"])), F.size(v["chars"]).cast("long"))
        )

    chars = F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0))
    fresh = F.when(F.size("spans") == 0, F.col(f"row.`{text}`")).otherwise(let(F.struct(chars.alias("chars"), by_place.alias("spans")), rewritten))
    return found.select(F.col("row").withField(f"`{text}`", fresh).alias("row")).select("row.*")


def digest(found: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select(
        F.col("key").alias("doc_id"),
        *[count(k) for k in KINDS],
        F.sha2(F.encode(joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
