"""Histories of states: drift, loops, progress, throttles and model checks over ordered rows.

Rows have a key, an order (time, then arrival) and a state; the distance of two states is |a - b| / scale, 1 at most. A key's rows
are ranked in one task, so a key is assumed to have a bounded history (snapshots of one thing); functions that only aggregate say
so and need no such bound. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import numbered


def _distance(a: Column, b: Column, scale: float) -> Column:
    # least() skips nulls, so a missing state must stay one
    return F.when(a.isNotNull() & b.isNotNull(), F.least(F.lit(1.0), F.abs(a - b) / F.lit(scale)))


def _listed(rows: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Each key's states in order, as an array ``v``."""
    both = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(value).alias("v"))
    return rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(both)), lambda x: x["v"]).alias("v"))


def drift_trends(rows: DataFrame, key: str, order: Sequence[str], value: str, scale: float) -> DataFrame:
    """Trend of each key by its first, middle and last state: expanding, contracting, stable or oscillating; and trajectory.

    The trajectory is monotone if no state is nearer to the first than the one before, returning if the last is nearer than the middle one,
    else chaotic. Fewer than three states are stable, with too little data for a trajectory. ``moved`` is the distance of first and last.
    """
    n = F.size("v")
    first, mid, last = F.get("v", F.lit(0)), F.get("v", F.floor(n / 2).cast("int")), F.get("v", n - 1)
    to_mid, from_mid, whole = _distance(first, mid, scale), _distance(mid, last, scale), _distance(first, last, scale)
    trend = (
        F.when(n < 3, "stable").when(whole > (to_mid + from_mid) * 0.8, "expanding").when(whole < 0.2, "contracting")
        .when(F.abs(to_mid - from_mid) < 0.1, "stable").otherwise("oscillating")
    )
    away = F.transform(F.slice("v", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda x: _distance(first, x, scale))
    listed = _listed(rows, key, order, value).withColumn("d", away)
    m = F.size("d")
    steady = F.forall(F.sequence(F.lit(0), F.greatest(m - 2, F.lit(0))), lambda i: F.coalesce(F.get("d", i) <= F.get("d", i + 1), F.lit(True)))
    path = F.when(n < 3, "insufficient_data").when(steady, "monotonic_drift").when(F.get("d", m - 1) < F.get("d", F.floor(m / 2).cast("int")), "returning_drift")
    return listed.select(key, n.alias("states"), trend.alias("trend"), path.otherwise("chaotic_drift").alias("trajectory"), F.round(whole, 6).alias("moved"))


def conceptual_drift(trends: DataFrame, states: int = 5, moved: float = 0.6) -> DataFrame:
    """Keys with enough states whose last lies far from the first."""
    return trends.where((F.col("states") >= states) & (F.col("moved") > moved))


def drift_summary(trends: DataFrame, high: float = 0.8) -> DataFrame:
    """Keys and high-risk keys of each trend; an aggregate only."""
    return trends.groupBy("trend").agg(F.count("*").alias("keys"), F.count_if(F.col("moved") > high).alias("high_risk"))


def dead_ends(rows: DataFrame, key: str, order: Sequence[str], value: str, scale: float, now: Column, burst: float = 0.5, quiet: float = 0.1, days: int = 30) -> DataFrame:
    """Keys that changed a lot on their first two days of change, little on their last four, and not for ``days`` before ``now``.

    Keys need three states, and two days of change. risk: high from 90 days, medium from 45.
    """
    over = Window.partitionBy(key).orderBy(*order)
    step = _distance(F.col(value), F.lag(value).over(over), scale)
    daily = rows.withColumn("step", step).groupBy(key, F.to_date(order[0]).alias("day")).agg(F.sum("step").alias("moved"), F.count("*").alias("n"), F.max(order[0]).alias("last"))
    changed = daily.withColumn("has", F.col("moved").isNotNull())
    ranks = Window.partitionBy(key, "has")
    ranked = changed.withColumns({"up": F.row_number().over(ranks.orderBy("day")), "down": F.row_number().over(ranks.orderBy(F.col("day").desc()))})
    facts = ranked.groupBy(key).agg(
        F.sum("n").alias("states"), F.count_if("has").alias("windows"), F.round(F.sum(F.when(F.col("has") & (F.col("up") <= 2), F.col("moved"))), 6).alias("burst"),
        F.round(F.sum(F.when(F.col("has") & (F.col("down") <= 4), F.col("moved"))), 6).alias("recent"), F.datediff(now, F.max("last")).alias("idle"),
    )
    found = facts.where((F.col("states") >= 3) & (F.col("windows") >= 2) & (F.col("burst") > burst) & (F.col("recent") < quiet) & (F.col("idle") > days))
    return found.withColumn("risk", F.when(F.col("idle") > 90, "high").when(F.col("idle") > 45, "medium").otherwise("low"))


def stability(rows: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """max(0, 1 - deviation / mean) of the last three rows up to each, 0 for the first and 1 for a mean of 0; and the change of the mean."""
    over = Window.partitionBy(key).orderBy(*order)
    near = over.rowsBetween(-2, Window.currentRow)
    mean, spread = F.avg(value).over(near), F.stddev_pop(value).over(near)
    calm = F.when(F.row_number().over(over) < 2, 0.0).when(mean == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - spread / mean))
    return rows.select(key, *order, F.round(calm, 4).alias("stability"), F.round(F.col(value) - F.lag(value).over(over), 6).alias("change"))


def loops(rows: DataFrame, key: str, order: Sequence[str], state: str) -> DataFrame:
    """Rows whose state is one of the three before, and whether they swing between two states."""
    over = Window.partitionBy(key).orderBy(*order)
    one, two, three = (F.lag(state, k).over(over) for k in (1, 2, 3))
    marked = rows.select(key, *order, F.col(state).alias("state"), one.alias("a"), two.alias("b"), three.alias("c"))
    looped = F.coalesce(F.col("state").isin(F.col("a"), F.col("b"), F.col("c")), F.lit(False))
    swing = F.coalesce((F.col("state") == F.col("b")) & (F.col("a") == F.col("c")) & (F.col("state") != F.col("a")), F.lit(False))
    return marked.select(key, *order, looped.alias("loop"), swing.alias("swing")).where("loop")


def continuation(rows: DataFrame, key: str, order: Sequence[str], print_: str, value: str, most: int = 20, least: float = 0.01) -> DataFrame:
    """What each iteration should do: limit from ``most`` on, loop for a fingerprint seen before, stalled if the value fell by a share of less
    than ``least``, else continue."""
    over = Window.partitionBy(key).orderBy(*order)
    seen = F.row_number().over(Window.partitionBy(key, print_).orderBy(*order))
    before = F.lag(value).over(over)
    gain = F.when(before == 0, 0.0).otherwise((before - F.col(value)) / before)
    verdict = F.when(F.row_number().over(over) > most, "limit").when(seen > 1, "loop").when(gain < least, "stalled").otherwise("continue")
    return rows.select(key, *order, verdict.alias("verdict"))


def burst_facts(rows: DataFrame, key: str, time: str) -> DataFrame:
    """Span in hours, whether all lies within a day, different days, and how even the gaps are (1 / (1 + deviation / mean)); time in seconds."""
    gap = F.col(time) - F.lag(time).over(Window.partitionBy(key).orderBy(time))
    gaps = rows.select(key, time, gap.alias("gap"))
    span = (F.max(time) - F.min(time)) / 3600.0
    even = F.coalesce(1 / (1 + F.stddev_pop("gap") / F.nullif(F.avg("gap"), F.lit(0.0))), F.lit(0.0))
    return gaps.groupBy(key).agg(
        F.count("*").alias("rows"), F.round(span, 4).alias("hours"), (span <= 24).alias("burst"), F.countDistinct(F.floor(F.col(time) / 86400)).alias("days"),
        F.round(even, 6).alias("evenness"),
    )


def throttled(rows: DataFrame, keys: Sequence[str], order: Sequence[str], every: int = 5) -> DataFrame:
    """The first row of each key and every fifth after (the 5th, 10th, ...)."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("nth", nth).where((F.col("nth") == 1) | (F.col("nth") % every == 0))


def silent(rows: DataFrame, key: str, time: str, limit: float) -> DataFrame:
    """Keys whose last sign of life (seconds) lies more than ``limit`` before the latest of all; an aggregate only."""
    last = rows.groupBy(key).agg(F.max(time).alias("last"))
    return last.crossJoin(last.agg(F.max("last").alias("now"))).where(F.col("now") - F.col("last") > limit).select(key, (F.col("now") - F.col("last")).alias("silence"))


def outcomes(rows: DataFrame, key: str, success: Column) -> DataFrame:
    """Tries, successes, failures and success rate of each key; an aggregate only."""
    return rows.groupBy(key).agg(F.count("*").alias("tries"), F.count_if(success).alias("successes"), F.count_if(~success).alias("failures"), F.round(F.avg(success.cast("int")), 6).alias("rate"))


def ranked_strategies(rows: DataFrame, key: str, parts: dict[str, float]) -> DataFrame:
    """Weighted sum of the means of some columns for each key, highest first; an aggregate only."""
    score = F.lit(0.0)
    for column, weight in parts.items():
        score = score + weight * F.avg(column)
    return rows.groupBy(key).agg(F.round(score, 6).alias("score")).orderBy(F.col("score").desc(), key)


def timings(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Count, total, mean, least and most of each key; an aggregate only."""
    return rows.groupBy(key).agg(
        F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value), 4).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most")
    )


def batches(rows: DataFrame, group: str, size: str, tie: str, most: int = 50) -> DataFrame:
    """Chunks of at most ``most`` rows of each group in descending size: the chunk's number from 0."""
    placed = numbered(rows, [F.col(size).desc(), tie], [group], "_nth")
    return placed.withColumn("batch", F.floor((F.col("_nth") - 1) / most).cast("int")).drop("_nth")


def validated(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: Pearson, Spearman, root mean square error and r squared of a guess.

    Ranks are means over ties of the numbers that a range sort gives, so no task holds all rows or all values.
    """

    def ranks(column: str, name: str) -> DataFrame:
        return numbered(rows.select(column), [column]).groupBy(column).agg(F.avg("nth").alias(name))

    joined = rows.join(ranks(truth, "rt"), truth).join(ranks(guess, "rg"), guess)
    error = F.sum(F.pow(F.col(truth) - F.col(guess), F.lit(2)))
    return joined.agg(
        F.round(F.corr(truth, guess), 6).alias("pearson"), F.round(F.corr("rt", "rg"), 6).alias("spearman"), F.round(F.sqrt(error / F.count("*")), 4).alias("rmse"),
        F.round(1 - error / (F.var_pop(truth) * F.count("*")), 6).alias("r2"),
    )


def cross_validated(rows: DataFrame, order: Sequence[str], truth: str, guess: str, folds: int = 5) -> DataFrame:
    """One row: mean over contiguous folds of the correlation of guess and truth. Folds differ by one row at most, larger ones first."""
    share, more = divmod(rows.count(), folds)
    at = F.col("_nth") - 1
    fold = F.when(at < more * (share + 1), F.floor(at / (share + 1))).otherwise(more + F.floor((at - more * (share + 1)) / max(share, 1)))
    by_fold = numbered(rows, order, name="_nth").groupBy(fold.alias("fold")).agg(F.corr(truth, guess).alias("r"))
    return by_fold.agg(F.count("*").alias("folds"), F.round(F.avg("r"), 6).alias("mean"))


def grid_search(rows: DataFrame, distance: str, truth: str, alphas: Sequence[float], scales: Sequence[float]) -> DataFrame:
    """The exponent and scale (a small stated grid) whose (distance + 1) ** -alpha x scale fits best: correlation minus squared error."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(a, b) for a in alphas for b in scales], "alpha double, scale double")
    met = rows.crossJoin(F.broadcast(grid)).withColumn("guess", F.col("scale") * F.pow(F.col(distance) + 1, -F.col("alpha")))
    fit = F.corr("guess", truth) - F.avg(F.pow(F.col("guess") - F.col(truth), F.lit(2)))
    scored = met.groupBy("alpha", "scale").agg(F.round(fit, 6).alias("fit"))
    return scored.orderBy(F.col("fit").desc(), "alpha", "scale").limit(1)
