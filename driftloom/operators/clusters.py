"""Groups and what is said about them: overlaps, representatives, samples, matrices as coordinates, layers, weighted patterns.

Memberships are rows (cluster, member); matrices are rows (i, j, value) and never dense. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import numbered


def representatives(members: DataFrame, cluster: str, member: str) -> DataFrame:
    """The least member of each cluster and its size."""
    return members.groupBy(cluster).agg(F.min(member).alias("representative"), F.count("*").alias("size"))


def overlapping(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs of a left and a right cluster (cluster, member) that share at least ``least`` of the smaller one: a, b, share."""
    size = lambda df, c, n: df.distinct().groupBy(F.col("cluster").alias(c)).agg(F.count("*").alias(n))
    shared = left.distinct().toDF("a", "member").join(right.distinct().toDF("b", "member"), "member").groupBy("a", "b").agg(F.count("*").alias("n"))
    joined = shared.join(size(left, "a", "na"), "a").join(size(right, "b", "nb"), "b")
    return joined.withColumn("share", F.round(F.col("n") / F.least("na", "nb"), 6)).where(F.col("share") >= least).select("a", "b", "share")


def absorbed(first: DataFrame, second: DataFrame) -> DataFrame:
    """Members of both clusterings (cluster, member), those of the second whose cluster touches none of the first only: kind, cluster, member."""
    touched = second.join(first.select("member").distinct(), "member", "left_semi").select("cluster").distinct()
    rest = second.join(touched, "cluster", "left_anti")
    return first.select(F.lit("first").alias("kind"), "cluster", "member").unionByName(rest.select(F.lit("second").alias("kind"), "cluster", "member"))


def grouped_by_keys(rows: DataFrame, member: str, keys: Mapping[str, Column], least: int = 2) -> DataFrame:
    """Groups of at least ``least`` members by each of several keys in one pass: by, key, members, first."""
    pairs = F.array(*[F.struct(F.lit(n).alias("by"), c.cast("string").alias("key")) for n, c in keys.items()])
    spread = rows.select(F.col(member).alias("member"), F.explode(pairs).alias("k")).select("member", "k.by", "k.key").where("key is not null")
    return spread.groupBy("by", "key").agg(F.count("*").alias("members"), F.min("member").alias("first")).where(F.col("members") >= least)


def inside_share(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Share of the outgoing edges (src, dst) of each cluster (cluster, member) that stay inside."""
    named = edges.join(members.toDF("c", "src"), "src").join(members.toDF("d", "dst"), "dst", "left")
    return named.groupBy(F.col("c").alias("cluster")).agg(F.count("*").alias("edges"), F.round(F.avg(F.coalesce((F.col("c") == F.col("d")).cast("int"), F.lit(0))), 6).alias("inside"))


def stability_index(rows: DataFrame, group: str, value: str) -> DataFrame:
    """One row: 1 / (1 + mean of deviation / mean over the groups with a mean that is not 0)."""
    by = rows.groupBy(group).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s")).where("m <> 0")
    return by.agg(F.round(1 / (1 + F.coalesce(F.avg(F.col("s") / F.col("m")), F.lit(0.0))), 6).alias("stability"))


def symmetric(pairs: DataFrame) -> DataFrame:
    """A similarity matrix from pairs (a, b, value): both directions and 1 on the diagonal, the greatest value of each place: i, j, value."""
    ends = pairs.select(F.col("a").alias("i")).union(pairs.select("b")).distinct()
    both = pairs.select(F.col("a").alias("i"), F.col("b").alias("j"), "value").union(pairs.select("b", "a", "value"))
    return both.union(ends.select("i", F.col("i").alias("j"), F.lit(1.0).alias("value"))).groupBy("i", "j").agg(F.max("value").alias("value"))


def glyphs(matrix: DataFrame, risks: DataFrame, marks: str = " .:*#") -> DataFrame:
    """Glyph of each place by its value between the least and the greatest, overlaid by its risk (i, j, risk) above 0.8, 0.5 or 0.2."""
    ends = matrix.agg(F.min("value").alias("low"), F.max("value").alias("high"))
    share = F.when(F.col("high") > F.col("low"), (F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    level = F.least(F.floor(share * (len(marks) - 1)), F.lit(len(marks) - 1)).cast("int")
    glyph = F.element_at(F.array(*[F.lit(m) for m in marks]), level + 1)
    overlay = F.when(F.col("risk") > 0.8, "!").when(F.col("risk") > 0.5, "^").when(F.col("risk") > 0.2, "~")
    return matrix.crossJoin(ends).join(risks, ["i", "j"], "left").select("i", "j", F.coalesce(overlay, glyph).alias("glyph"))


def changed_totals(before: DataFrame, after: DataFrame, domain: Column) -> DataFrame:
    """Totals of two matrices for each domain (an expression over i), change and percent (0 from nothing): domain, before, after, change, percent."""
    both = before.select("i", F.col("value").alias("x"), F.lit(0.0).alias("y")).unionByName(after.select("i", F.lit(0.0).alias("x"), F.col("value").alias("y")))
    total = both.groupBy(domain.alias("domain")).agg(F.round(F.sum("x"), 4).alias("before"), F.round(F.sum("y"), 4).alias("after"))
    change = F.round(F.col("after") - F.col("before"), 4)
    return total.select("domain", "before", "after", change.alias("change"), F.when(F.col("before") == 0, 0.0).otherwise(F.round(100 * change / F.col("before"), 4)).alias("percent"))


def staged_sample(rows: DataFrame, key: str, strata: Mapping[str, tuple[Column, int]]) -> DataFrame:
    """Rows by stages: the first rows (by a hash of the key) of each value of a stratum, so many a value, then the next stratum from the rest.

    The numbers are the feature. Result: key, stage.
    """
    order = [F.md5(F.col(key).cast("string")), key]
    left, out = rows, None
    for name, (value, n) in strata.items():
        ranked = numbered(left.withColumn("_value", value), order, ["_value"]).where(F.col("nth") <= n)
        got = ranked.select(key, F.lit(name).alias("stage"))
        left = left.join(got.select(key), key, "left_anti")
        out = got if out is None else out.unionByName(got)
    return out


def pattern_score(text: Column, weights: Mapping[str, float], extra: Column | None = None) -> Column:
    """Sum of pattern counts times weights and an extra term, 1 at most; null text counts as empty."""
    total = F.lit(0.0) if extra is None else extra
    for pattern, weight in weights.items():
        total = total + weight * F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern))
    return F.least(F.lit(1.0), total)


def repetitive(items: Column, placeholder: str) -> Column:
    """What a list of strings is: numbered (one stem with numbers), placeholder (all match a form), uniform (one value three times or more)."""
    stem = F.array_distinct(F.transform(items, lambda x: F.regexp_replace(x, "[0-9]+", "#")))
    numbered = (F.size(items) >= 3) & (F.size(stem) == 1) & (F.size(F.array_distinct(items)) == F.size(items)) & F.forall(items, lambda x: x.rlike("[0-9]"))
    holds = (F.size(items) > 0) & F.forall(items, lambda x: x.rlike(placeholder))
    uniform = (F.size(items) >= 3) & (F.size(F.array_distinct(items)) == 1)
    return F.when(numbered, "numbered").when(holds, "placeholder").when(uniform, "uniform")


def layered(rows: DataFrame, path: Column, layers: Mapping[str, str]) -> DataFrame:
    """Rows of each layer (the first whose form the path matches, else unknown); layers without rows stay: layer, rows."""
    out = F.lit("unknown")
    for name, form in reversed(list(layers.items())):
        out = F.when(path.rlike(form), name).otherwise(out)
    counted = rows.groupBy(out.alias("layer")).agg(F.count("*").alias("n"))
    names = rows.sparkSession.createDataFrame([(n,) for n in [*layers, "unknown"]], "layer string")
    return names.join(counted, "layer", "left").select("layer", F.coalesce("n", F.lit(0)).alias("rows"))


def unused_imports(imports: DataFrame, uses: DataFrame) -> DataFrame:
    """Share of the imported names (file, name) of each file that it never uses (file, name): file, imports, unused, ratio."""
    used = uses.select("file", "name").distinct().withColumn("u", F.lit(1))
    joined = imports.join(used, ["file", "name"], "left")
    return joined.groupBy("file").agg(F.count("*").alias("imports"), F.count_if(F.col("u").isNull()).alias("unused"), F.round(F.avg(F.col("u").isNull().cast("int")), 6).alias("ratio"))


def spread_of(members: DataFrame, cluster: str, value: str, least: int = 2) -> DataFrame:
    """Size, mean, and variance by mean of a value over each cluster of at least ``least`` members."""
    grouped = members.groupBy(cluster).agg(F.count("*").alias("size"), F.round(F.avg(value), 4).alias("mean"), F.round(F.var_pop(value) / F.nullif(F.avg(value), F.lit(0.0)), 4).alias("spread"))
    return grouped.where(F.col("size") >= least)


def between_snapshots(rows: DataFrame, key: str, snapshot: str, value: str) -> DataFrame:
    """Each key in two consecutive snapshots (whole numbers): snapshot, kept, changed, added, gone."""
    now = rows.select(F.col(key).alias("k"), F.col(snapshot).alias("s"), F.col(value).alias("v"), F.lit(1).alias("now"), F.lit(0).alias("old"))
    last = rows.select(F.col(key).alias("k"), (F.col(snapshot) + 1).alias("s"), F.col(value).alias("w"), F.lit(0).alias("now"), F.lit(1).alias("old"))
    both = now.unionByName(last, allowMissingColumns=True).groupBy("k", "s").agg(F.max("v").alias("v"), F.max("w").alias("w"), F.max("now").alias("now"), F.max("old").alias("old"))
    both = both.join(rows.agg(F.max(snapshot).alias("end")).withColumn("start", F.lit(0)), F.col("s") <= F.col("end"))
    return both.groupBy(F.col("s").alias("snapshot")).agg(
        F.count_if(F.expr("now = 1 and old = 1 and v = w")).alias("kept"), F.count_if(F.expr("now = 1 and old = 1 and v <> w")).alias("changed"), F.count_if(F.expr("old = 0")).alias("added"), F.count_if(F.expr("now = 0")).alias("gone")
    )


def lacking_checks(rows: DataFrame, group: str, checks: Sequence[str], least: int = 2) -> DataFrame:
    """Groups in which at least ``least`` of some boolean columns are never true: group, lacking."""
    found = rows.groupBy(group).agg(*[F.max(F.coalesce(F.col(c), F.lit(False)).cast("int")).alias(c) for c in checks])
    lacking = sum((1 - F.col(c) for c in checks), F.lit(0))
    return found.select(group, lacking.alias("lacking")).where(F.col("lacking") >= least)


def greedy_facilities(costs: DataFrame, k: int) -> DataFrame:
    """``k`` facilities (site, client, cost) picked one by one, each the site that lowers the summed cost of all clients most: nth, site, total.

    One job for each pick; sites and clients stay distributed. Ties go to the least site.
    """
    best, picked = None, []
    for nth in range(1, k + 1):
        now = costs if best is None else costs.join(best, "client").withColumn("cost", F.least("cost", "best"))
        total = now.groupBy("site").agg(F.round(F.sum("cost"), 6).alias("total"))
        row = total.orderBy("total", "site").first()
        if row is None:
            break
        picked.append((nth, row.site, row.total))
        chosen = [s for _, s, _ in picked]
        best = costs.where(F.col("site").isin(*chosen)).groupBy("client").agg(F.min("cost").alias("best"))
    return costs.sparkSession.createDataFrame(picked, "nth int, site long, total double")
