"""Co-occurrence and linkage over baskets (basket, item)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components


def pairs(baskets: DataFrame) -> DataFrame:
    """Pairs of items with the baskets of each and of both: a, b, na, nb, both. Work is the sum of squared basket sizes."""
    slim = baskets.select("basket", "item").distinct()
    sizes = slim.groupBy("item").agg(F.count("*").alias("n"))
    left, right = slim.select("basket", F.col("item").alias("a")), slim.select("basket", F.col("item").alias("b"))
    both = left.join(right, "basket").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    named = both.join(sizes.select(F.col("item").alias("a"), F.col("n").alias("na")), "a")
    return named.join(sizes.select(F.col("item").alias("b"), F.col("n").alias("nb")), "b").select("a", "b", "na", "nb", "both")


def frequency(baskets: DataFrame) -> DataFrame:
    """Share of the rarer item's baskets that hold both."""
    return pairs(baskets).select("a", "b", "both", F.round(F.col("both") / F.least("na", "nb"), 6).alias("frequency"))


def linkage(baskets: DataFrame) -> DataFrame:
    """Lewontin's D' from the items' own frequencies: a, b, d, d_prime."""
    total = baskets.select("basket").distinct().agg(F.count("*").alias("n"))
    p = pairs(baskets).join(F.broadcast(total))
    pa, pb, pab = F.col("na") / F.col("n"), F.col("nb") / F.col("n"), F.col("both") / F.col("n")
    d = pab - pa * pb
    most = F.when(d >= 0, F.least(pa * (1 - pb), (1 - pa) * pb)).otherwise(F.least(pa * pb, (1 - pa) * (1 - pb)))
    return p.select("a", "b", F.round(d, 6).alias("d"), F.round(F.when(most == 0, 0.0).otherwise(d / most), 6).alias("d_prime"))


def groups(baskets: DataFrame, least: float) -> DataFrame:
    """Components of the pairs with at least that frequency: node, component."""
    strong = frequency(baskets).where(F.col("frequency") >= least)
    return components(strong.select(F.col("a").alias("src"), F.col("b").alias("dst")))
