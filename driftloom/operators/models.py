"""Models over feature columns: forests for risk, density clusters for what is normal.

Forests are fitted by Spark's own distributed trees with a fixed seed. Empty tables cannot be fitted (an error says so); density clusters of
an empty table are empty. Rows with a null feature or label do not train and get a null risk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components


def train_forest(rows: DataFrame, features: Sequence[str], label: str, trees: int = 100):
    """A forest over numeric columns for a 0/1 label."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    clean = rows.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("_y")).na.drop()
    vectors = VectorAssembler(inputCols=list(features), outputCol="_x").transform(clean)
    return RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, seed=42).fit(vectors)


def predict_risk(model, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """The rows with ``risk``, the forest's probability of label 1."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    known = F.lit(True)
    for c in features:
        known = known & F.col(c).isNotNull()
    safe = rows.select("*", known.alias("_known"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_f{i}") for i, c in enumerate(features)])
    vectors = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol="_x").transform(safe)
    scored = model.transform(vectors.withColumnRenamed("_x", model.getFeaturesCol()))
    return scored.select(*rows.columns, F.when(F.col("_known"), vector_to_array("probability")[1]).alias("risk"))


def density_clusters(nodes: DataFrame, pairs: DataFrame, least: int = 5) -> DataFrame:
    """Clusters by density: node, cluster (least core node of it), null for noise.

    ``pairs`` (a, b) are the near ones, each once. A node with ``least`` neighbours, itself counted, is a core; cores that are near are one
    cluster; other nodes near a core join the least such cluster.
    """
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    core = both.groupBy("a").count().where(F.col("count") + 1 >= least).select(F.col("a").alias("node"))
    if least <= 1:
        core = nodes.select("node").distinct()
    left, right = core.withColumnRenamed("node", "a"), core.withColumnRenamed("node", "b")
    inner = both.join(left, "a", "left_semi").join(right, "b", "left_semi").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    found = core.join(components(inner), "node", "left").select("node", F.coalesce("component", "node").alias("cluster"))
    near = both.join(found.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("cluster").alias("border"))
    joined = nodes.select("node").distinct().join(found, "node", "left").join(near, "node", "left")
    return joined.select("node", F.coalesce("cluster", "border").alias("cluster"))
