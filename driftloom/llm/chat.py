"""Chat formatting: conversations rebuilt from event logs, rendered with a loss mask.

``fold`` partitions the log by conversation, orders it by sequence number and folds streamed deltas, edits and
regenerations into final messages. ``render`` writes a conversation as one string and marks what the loss covers;
``parse`` reads the string back.

A turn is ``### <role>: <text> </turn>`` and a line end. Control strings inside texts are replaced reversibly: the
backslash by ``\\s``, ``###`` by ``\\h``, ``</turn>`` by ``\\e``; in roles also ``:`` by ``\\c`` and the line end by ``\\n``. After that no text
holds a mark, every backslash starts a code, and undoing the codes (the backslash's last) gives the text.

Defined cases: null texts and roles count as empty; a null kind is a message; rows with equal sequence numbers are
ordered by role and text, and repeated rows stay repeated turns; a delta before any message starts one; an empty table
gives an empty result. Extra columns do not matter. All rows of a conversation become one row, as its output is one string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

OPEN, MID, CLOSE = "### ", ": ", " </turn>\n"
LEARNED = "assistant"
TEXT_CODES = (("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\e"))
ROLE_CODES = (*TEXT_CODES, (":", "\\c"), ("\n", "\\n"))


def _escape(c: Column, codes: tuple[tuple[str, str], ...] = TEXT_CODES) -> Column:
    for plain, code in codes:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def _unescape(c: Column, codes: tuple[tuple[str, str], ...] = TEXT_CODES) -> Column:
    for plain, code in reversed(codes):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def fold(
    events: DataFrame,
    conv: str = "conv_id",
    seq: str = "turn",
    role: str = "role",
    text: str = "text",
    kind: str | None = None,
    target: str | None = None,
) -> DataFrame:
    """One row per final message: conv, seq, nth (among equal seqs), role, text.

    Kinds: ``message`` starts a message; ``delta`` appends to the latest one; ``edit`` replaces the text of the message whose
    seq is ``target`` (the latest if null), later deltas append to that text; ``regenerate`` starts a message in place of
    the latest, if that is the assistant's. All steps share one partitioning by conversation.
    """
    log = events.select(
        F.col(conv).alias("conv"),
        F.col(seq).alias("seq"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        (F.coalesce(F.col(kind), F.lit("message")) if kind else F.lit("message")).alias("kind"),
        (F.col(target) if target else F.lit(None)).cast("long").alias("target"),
    )
    order = Window.partitionBy("conv").orderBy("seq", "role", "text")
    log = log.withColumn("n", F.row_number().over(order))
    log = log.withColumn("starts", F.col("kind").isin("message", "regenerate") | (F.col("n") == 1))
    log = log.withColumn("nth", F.row_number().over(Window.partitionBy("conv", "seq", "starts").orderBy("n")))
    own = F.struct(F.col("seq").alias("seq"), F.col("nth").alias("nth"))
    so_far = Window.partitionBy("conv").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = F.last(F.when(F.col("starts"), own), ignorenulls=True).over(so_far)
    aimed = F.struct(F.col("target").alias("seq"), F.lit(1).alias("nth"))
    next_kind = F.lead("kind").over(Window.partitionBy("conv", "starts").orderBy("n"))
    log = log.withColumns(
        {
            "message": F.when((F.col("kind") == "edit") & F.col("target").isNotNull() & ~F.col("starts"), aimed).otherwise(latest),
            "dropped": F.col("starts") & (F.col("role") == LEARNED) & (F.coalesce(next_kind, F.lit("")) == "regenerate"),
        }
    )
    steps = (
        log.groupBy("conv", "message")
        .agg(
            F.sort_array(F.collect_list(F.struct("n", "starts", "kind", "text"))).alias("steps"),
            F.max(F.when(F.col("starts"), F.col("role"))).alias("role"),
            F.bool_or("dropped").alias("dropped"),
            F.max(F.when(F.col("starts") | (F.col("kind") == "edit"), F.col("n"))).alias("since"),
        )
        .where(~F.col("dropped") & F.col("role").isNotNull())
    )
    return steps.select(
        "conv",
        F.col("message.seq").alias("seq"),
        F.col("message.nth").alias("nth"),
        "role",
        F.array_join(F.transform(F.filter("steps", lambda s: s["n"] >= F.col("since")), lambda s: s["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (turn, start, end).

    A span's turn counts from 0; start and end are code points inside that turn's part of ``formatted``, end exclusive.
    """
    opened = F.concat(F.lit(OPEN), _escape(F.col("role"), ROLE_CODES), F.lit(MID))
    turns = messages.select("conv", "seq", "nth", "role", opened.alias("opened"), _escape(F.col("text")).alias("inner"))
    piece = F.concat(F.col("opened"), F.col("inner"), F.lit(CLOSE))
    span = F.when(
        F.col("role") == LEARNED,
        F.struct(F.length("opened").alias("start"), (F.length("opened") + F.length("inner")).alias("end")),
    )
    rows = turns.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("seq", "nth", piece.alias("piece"), span.alias("span")))).alias("turns")
    )
    spans = F.filter(
        F.transform(
            "turns",
            lambda t, i: F.struct(i.alias("turn"), t["span"]["start"].alias("start"), t["span"]["end"].alias("end")),
        ),
        lambda s: s["start"].isNotNull(),
    )
    return rows.select(
        F.col("conv").alias("conv_id"),
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def parse(formatted: DataFrame) -> DataFrame:
    """Reads rendered conversations back: conv_id, turns (role, text), loss (the texts under the mask), formatted_chars."""
    pieces = F.expr(r"split(formatted, ' </turn>\\n')")
    role = lambda p: _unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), ":", 1), ROLE_CODES)
    after = lambda p: F.substr(p, F.instr(p, MID) + len(MID))
    real = F.slice(pieces, 1, F.size(pieces) - 1)
    turns = let(real, lambda ps: F.transform(ps, lambda p: F.struct(role(p).alias("role"), _unescape(after(p)).alias("text"))))
    loss = let(
        F.struct(pieces.alias("p"), F.col("loss_spans").alias("s")),
        lambda v: F.transform(
            v["s"], lambda s: _unescape(F.substr(F.get(v["p"], s["turn"]), s["start"] + 1, s["end"] - s["start"]))
        ),
    )
    return formatted.select(
        "conv_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars")
    )


def digest(parsed: DataFrame) -> DataFrame:
    """Lengths and hashes of what was read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.withColumn("learned", F.array_join("loss", "")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.encode(F.col("learned"), "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\e') as te,
  replace(replace(replace(replace(replace(role, '\', '\s'), '###', '\h'), '</turn>', '\e'), ':', '\c'), chr(10), '\n') as re from t)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(te) + length(re) + 4 + 2 + 9)::bigint as formatted_chars
from e group by conv_id
"""
