"""MinHash signatures, bit signatures and the cascades that search with them.

Signatures are arrays of non-negative numbers, bit signatures arrays of 64-bit words; equal inputs give equal ones in every run.
Candidates come from equi-joins on buckets; a bucket's pairs are its own size squared, so buckets that hold very many rows are
met through their first row (``bucket_links``), which keeps each group of equals connected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged(a: Column, b: Column) -> Column:
    """Signature of the union of two sets: the lesser of each place."""
    return F.zip_with(a, b, lambda x, y: F.least(x, y))


def estimate(a: Column, b: Column) -> Column:
    """Share of equal places: an estimate of the Jaccard similarity."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def bands_rows(n: int, threshold: float) -> tuple[int, int]:
    """Bands and rows for ``n`` hashes: rows near the root of n, more from a threshold of 0.7 up, fewer from 0.3 down."""
    if n < 16:
        return n, 1
    divisors = [r for r in range(1, n + 1) if n % r == 0]
    rows = max(r for r in divisors if r <= max(1, round(math.sqrt(n))))
    if threshold >= 0.7:
        rows = min((r for r in divisors if r > rows), default=rows)
    elif threshold <= 0.3 and rows > 1:
        rows = max(r for r in divisors if r < rows)
    return n // rows, rows


def bit_signature(features: Column, words: int) -> Column:
    """Sets one of ``64 * words`` bits for each feature, named by its MD5: an array of words."""
    place = F.transform(features, lambda f: F.conv(F.substring(F.md5(f), 1, 8), 16, 10).cast("bigint") % (64 * words))

    def word(w: Column) -> Column:
        own = F.filter(place, lambda p: F.floor(p / 64) == w)
        bits = F.transform(own, lambda p: F.call_function("shiftleft", F.lit(1).cast("bigint"), (p % 64).cast("int")))
        return F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, v: s.bitwiseOR(v))

    return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), word)


def _ones(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, v: s + F.bit_count(v))


def bit_jaccard(a: Column, b: Column) -> Column:
    """Bits in both by bits in either; 1 for none in either."""
    either = _ones(F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)))
    return F.when(either == 0, 1.0).otherwise(_ones(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))) / either)


def bit_distance(a: Column, b: Column) -> Column:
    """Number of unequal bits."""
    return _ones(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)))


def popcount(a: Column) -> Column:
    """Number of set bits."""
    return _ones(a)


def cascade(rows: DataFrame, key: str, first: str, second: str, third: str, least2: float = 0.35, least3: float = 0.25) -> DataFrame:
    """Pairs (a, b) with equal first signatures, second ones alike by ``least2`` and third ones by ``least3``.

    Equal rows of all three signatures are one class first, whose members need no pairs: a and b are class representatives (the least
    keys), and ``members`` and ``members_b`` say how many rows each stands for.
    """
    classes = rows.groupBy(first, second, third).agg(F.min(key).alias("rep"), F.count("*").alias("members"))
    left = classes.select(F.col("rep").alias("a"), "members", F.col(first).alias("s1"), F.col(second).alias("a2"), F.col(third).alias("a3"))
    right = classes.select(F.col("rep").alias("b"), F.col("members").alias("members_b"), F.col(first).alias("s1"), F.col(second).alias("b2"), F.col(third).alias("b3"))
    met = left.join(right, "s1").where("a < b").where(bit_jaccard(F.col("a2"), F.col("b2")) >= least2)
    return met.where(bit_jaccard(F.col("a3"), F.col("b3")) >= least3).select("a", "b", "members", "members_b")


def refined(pairs: DataFrame, rows: DataFrame, key: str, second: str, third: str, least2: float = 0.35, least3: float = 0.25) -> DataFrame:
    """Given pairs (a, b) that pass the second and third signature."""
    left = rows.select(F.col(key).alias("a"), F.col(second).alias("a2"), F.col(third).alias("a3"))
    right = rows.select(F.col(key).alias("b"), F.col(second).alias("b2"), F.col(third).alias("b3"))
    met = pairs.join(left, "a").join(right, "b").where(bit_jaccard(F.col("a2"), F.col("b2")) >= least2)
    return met.where(bit_jaccard(F.col("a3"), F.col("b3")) >= least3).select("a", "b")


def probe(queries: DataFrame, index: DataFrame, key: str, bands: int, least: float) -> DataFrame:
    """Rows whose signature ``sig`` shares a band with a query's and is alike by ``least``: query, key, likeness. Queries are a stated set."""

    def banded(df: DataFrame) -> DataFrame:
        wide = F.size("sig") / bands
        cut = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.concat_ws(":", i.cast("string"), F.array_join(F.transform(F.slice("sig", (i * wide + 1).cast("int"), wide.cast("int")), lambda v: v.cast("string")), ",")))
        return df.select(key, "sig", F.explode(cut).alias("band"))

    asked = banded(queries).select(F.col(key).alias("query"), F.col("sig").alias("own"), "band")
    met = asked.join(banded(index), "band").dropDuplicates(["query", key])
    return met.withColumn("likeness", F.round(estimate(F.col("own"), F.col("sig")), 6)).where(F.col("likeness") >= least).select("query", key, "likeness")


def bucket_links(rows: DataFrame, bucket: str, key: str) -> DataFrame:
    """Links (a, b) from each row to the first of its bucket: linear, and the components are those of all pairs."""
    first = rows.groupBy(bucket).agg(F.min(key).alias("a"))
    return rows.select(bucket, F.col(key).alias("b")).join(first, bucket).where("a <> b").select("a", "b").distinct()


def unseen(pairs: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs (a, b) that were not compared before, in either order."""
    known = done.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(known, ["a", "b"], "left_anti")
