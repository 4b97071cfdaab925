"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component, for nodes that have a link.

    ``links``: (a, b). Every round takes the least label among the neighbours and then that
    label's own label, so long chains halve. Rounds are written, which cuts lineage. Sums by
    node are combined before the shuffle; joins can be split where a node has many links.
    """
    both = written(links.where(F.col("a") != F.col("b")).select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("least"))
        hooked = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        hooked = written(hooked, "labels")
        up = hooked.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        jumped = hooked.join(up, F.col("label") == F.col("_n"), "left").select("node", "old", F.least("label", "_l").alias("label"))
        jumped = written(jumped, "labels")
        labels = jumped.select("node", "label")
        if not jumped.where(F.col("old") != F.col("label")).limit(1).count():
            return labels
