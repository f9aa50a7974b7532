"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a hashed order, every target its weight. A copy of a document has the virtual
finish time (words of its source up to and including it) / (target of its source); copy e comes after e whole passes over
the source. Sorting all copies by finish time serves the sources in proportion to their targets; as the targets add up to
the budget, the budget is spent exactly when virtual time reaches 1. The order is truncated there: the copies that are in
service then are cut, at most one for each source, so each source gives its target to the word. (Cutting the last copy of the
order alone would let a source miss its target by a document, which is much for sources of few documents.)

No text travels through the plan; ``mix`` joins texts to it at the end.

Running sums never gather a source in one task: a document's hash also names one of ``SLOTS`` slots, sums run inside
(source, slot), and the slots' totals are added up first. A source with any share of the rows is thus spread evenly.

Defined cases: null texts and empty texts have size 0 and take 0; null keys are rows of their own, hashed by their text; the null source is a source of its own, last in order;
documents with equal hashes (repeated rows) are ordered by size and otherwise interchangeable; an empty table gives an
empty result; a table without any word gives targets of 0. Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, checkpointed, word_count

#: Slots of a source's hashed order, named by the first three hex digits of the hash.
SLOTS = 4096
WEIGHTS = (5, 2, 1)
SHARE = 1.5
COPIES = 2


def _targets(totals: DataFrame, weights: Sequence[int], share: float, copies: int) -> DataFrame:
    """Target of each source: the budget shared by weight, at most ``copies`` times the size.

    The excess of capped sources is reshared until none is above. In the order of size by weight, the capped sources come
    first, and the level that the others share follows from running sums. Rows here are sources, not documents.
    """
    by_name, all_rows = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy(F.lit(0))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
    first = Window.orderBy((copies * F.col("source_size")) / F.col("weight"), F.col("source").asc_nulls_last())
    upto = first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    since = first.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    leveled = ranked.withColumns(
        {
            "cap": copies * F.col("source_size"),
            "before": F.sum(copies * F.col("source_size")).over(upto) - copies * F.col("source_size"),
            "left": F.sum("weight").over(since),
            "budget": F.sum("source_size").over(all_rows) * F.lit(float(share)),
        }
    ).withColumn("level", (F.col("budget") - F.col("before")) / F.col("left"))
    above = F.col("cap") > F.col("level") * F.col("weight")
    level = F.max(F.when(above, F.col("level"))).over(all_rows)
    return leveled.select(
        "source",
        "source_size",
        F.when(above, level * F.col("weight")).otherwise(F.col("cap").cast("double")).alias("target"),
    )


def schedule(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    copies: int = COPIES,
    seed: int = 7,
    row: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, ``served`` (words taken of each copy),
    ``finish`` (virtual finish time of each copy) and taken. ``row`` names a struct column to carry along.
    """
    # rows without a key are spread by their text
    name = F.coalesce(F.col(key).cast("string"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    digest = F.md5(F.concat(name, F.lit(f":{seed}")))
    carried = [F.col(row).alias("row")] if row else []
    sized = docs.select(
        F.col(key).alias("doc_id"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        digest.alias("hash"),
        *carried,
    ).withColumn("slot", F.conv(F.substring("hash", 1, 3), 16, 10).cast("int"))
    slots = sized.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    targets = _targets(slots.groupBy("source").agg(F.sum("slot_size").alias("source_size")), weights, share, copies)
    so_far = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = (
        slots.withColumn("base", F.sum("slot_size").over(so_far) - F.col("slot_size"))
        .join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .select(F.col("source").alias("_source"), F.col("slot").alias("_slot"), "base", "source_size", "target")
    )
    inside = (
        Window.partitionBy("source", "slot")
        .orderBy("hash", "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = (
        sized.withColumn("upto", F.sum("size").over(inside))
        .join(bases, F.col("source").eqNullSafe(F.col("_source")) & (F.col("slot") == F.col("_slot")))
        .withColumn("start", F.col("base") + F.col("upto") - F.col("size"))
    )
    starts = F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda e: e * F.col("source_size") + F.col("start"))
    goal = F.floor("target").cast("long")
    served = F.transform(starts, lambda s: F.greatest(F.least(goal - s, F.col("size")), F.lit(0).cast("long")))
    return joined.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        served.alias("served"),
        F.transform(starts, lambda s: (s + F.col("size")) / F.col("target")).alias("finish"),
        *(["row"] if row else []),
    ).withColumn("taken", F.aggregate("served", F.lit(0).cast("long"), lambda a, x: a + x))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mixed documents with their own columns, in the order of virtual finish time, up to the budget.

    A document that is taken twice is there twice. The copy that the budget cuts keeps as many words as the mix takes of
    it, with the white space between them. Rows are planned by two hashes of all their columns and meet their texts once;
    the global order is one range sort.
    """
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    own = F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))
    slim = docs.select(own.alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(source).alias("_source"))
    planned = checkpointed(schedule(slim, "_key", "_text", "_source", row="_row", **how).select("row", "size", "served", "finish"))
    copies = planned.select("row", "size", F.explode(F.arrays_zip("served", "finish")).alias("copy")).where("copy.served > 0")
    copies = copies.select("row", "size", "copy.served", "copy.finish")
    texts = docs.select(own.alias("row"), F.struct("*").alias("whole"))
    if planned.groupBy("row").count().where("count > 1").take(1):
        texts = texts.dropDuplicates(["row"])  # rows that are repeated whole; any one serves all copies
    taken = F.slice(F.split(F.ltrim(F.col("_t"), F.lit(SPACES)), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"), 1, F.col("served").cast("int"))
    return (
        texts.join(copies, "row")
        .select("whole", "size", "served", "finish", F.col(f"whole.`{text}`").alias("_t"))
        .select("whole", "finish", F.when(F.col("served") < F.col("size"), F.btrim(F.array_join(taken, ""), F.lit(SPACES))).otherwise(F.col("_t")).alias("_t"))
        .orderBy("finish")
        .select(F.col("whole").withField(f"`{text}`", F.col("_t")).alias("whole"))
        .select("whole.*")
    )


ORACLE = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5(doc_id::varchar || ':7') as hash from documents),
totals as (
  select source, sum(size)::bigint as source_size, [5.0::double, 2.0::double, 1.0::double]
         [1 + (row_number() over (order by source asc nulls last) - 1) % 3] as weight from sized group by source),
leveled as (
  select *, 2 * source_size as cap, (sum(source_size) over ())::double * 1.5 as budget,
    (sum(2 * source_size) over (order by 2 * source_size / weight, source asc nulls last
         rows between unbounded preceding and current row) - 2 * source_size)::double as before_,
    sum(weight) over (order by 2 * source_size / weight, source asc nulls last
         rows between current row and unbounded following) as left_ from totals),
levels as (select *, (budget - before_) / left_ as level_ from leveled),
targets as (
  select source, source_size, case when cap > level_ * weight
           then (max(case when cap > level_ * weight then level_ end) over ()) * weight
           else cap::double end as target from levels),
placed as (
  select d.*, t.source_size, t.target, floor(t.target)::bigint as goal,
         (sum(size) over (partition by d.source order by hash, size
            rows between unbounded preceding and current row) - size)::bigint as start
  from sized d join targets t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (greatest(least(goal - start, size), 0) + greatest(least(goal - source_size - start, size), 0))::bigint as taken
from placed
"""
