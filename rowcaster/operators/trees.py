"""Nodes of fitted trees as a table, and the paths to their leaves by joining it level by level."""

from __future__ import annotations

import math

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import current, new_path, written
from .boosting import JointBoostingModel

#: A row per node: leaves have left = -1. ``value`` is what a leaf adds, ``cover`` the weight that reached the node.
NODES = "tree int, node int, left int, right int, feature int, cut double, cover double, value double"


def node_table(model: Model, class_index: int) -> DataFrame:
    """Nodes of all trees that make the score of a class: a share (forest) or a margin (boosted)."""
    if isinstance(model, JointBoostingModel):
        return model.nodes_of(class_index)
    spark = current()
    path = new_path(spark, "nodes")
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    stats = F.col("impurityStats")
    if isinstance(model, RandomForestClassificationModel):
        total = F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)
        rows = saved.select("*", F.lit(1.0 / model.getNumTrees).alias("weight"), (stats[class_index] / total).alias("own"), total.alias("cover"))
    elif isinstance(model, GBTClassificationModel):
        sign = 1.0 if class_index == 1 else -1.0
        weights = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "about", "w").select("treeID", (F.col("w") * sign).alias("weight"))
        rows = saved.join(weights, "treeID").select("*", F.col("prediction").alias("own"), stats[0].alias("cover"))
    else:
        raise TypeError(f"a {type(model).__name__} has no trees")
    return rows.select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("cut"), "cover",
        (F.col("weight") * F.col("own")).alias("value"),
    )


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """(tree, value, path) of every leaf; ``path`` has an entry (feature, share, low, high) per feature.

    A feature met several times becomes one interval (low, high] and the product of its cover
    shares. Every level joins the nodes once more, so there are as many joins as levels,
    whatever the number of trees.
    """
    nodes = written(nodes, "nodes")
    infinity = F.lit(math.inf)
    none = F.array().cast("array<struct<feature:int,share:double,low:double,high:double>>")
    at = nodes.where("node = 0").withColumn("path", none)
    leaves = None
    while True:
        at = written(at, "paths")
        ended = at.where("left < 0").select("tree", "value", "path")
        leaves = ended if leaves is None else leaves.unionByName(ended)
        inner = at.where("left >= 0")
        if not inner.limit(1).count():
            return leaves
        children = F.array(F.struct(F.col("left").alias("child"), F.lit(True).alias("below")), F.struct(F.col("right").alias("child"), F.lit(False).alias("below")))
        steps = inner.select("tree", F.col("feature").alias("_f"), F.col("cut").alias("_t"), F.col("cover").alias("_c"), F.col("path").alias("_path"), F.inline(children))
        steps = steps.withColumnsRenamed({"child": "node"}).join(nodes, ["tree", "node"])
        last = F.get(F.filter("_path", lambda e: e["feature"] == F.col("_f")), F.lit(0))
        share, low, high = F.coalesce(last["share"], F.lit(1.0)), F.coalesce(last["low"], -infinity), F.coalesce(last["high"], infinity)
        entry = F.struct(
            F.col("_f").alias("feature"), (share * F.col("cover") / F.col("_c")).alias("share"),
            F.when(F.col("below"), low).otherwise(F.greatest(low, F.col("_t"))).alias("low"),
            F.when(F.col("below"), F.least(high, F.col("_t"))).otherwise(high).alias("high"),
        )
        path = F.concat(F.filter("_path", lambda e: e["feature"] != F.col("_f")), F.array(entry))
        at = steps.select(*nodes.columns, path.alias("path"))
