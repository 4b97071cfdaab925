"""Attributions of linear models over the entries a row has, for vectors of any width.

The contribution of a feature to a row is coefficient * (value - mean). A row has few entries
(its numbers, and one category per text column); every other feature contributes the same
-coefficient * mean to all rows that lack it. So means come from sums over entries, and the
mean absolute contribution of a feature from its entries and the number of rows without one.
The largest contributions of a row are among its entries and the first of one list of the
rest, as many as asked for and the row's entries together. No plan grows with the categories.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dictionary import BROADCAST_BYTES
from .features import FeatureModel, plain_columns, width


def class_coefficients(model: PipelineModel, class_index: int) -> DataFrame:
    """(position, coefficient) of one class of a linear model."""
    matrix = model.stages[-1].coefficientMatrix.toArray()
    row = matrix[0] if matrix.shape[0] == 1 else matrix[class_index]
    spark = model.stages[0].names().sparkSession
    return spark.createDataFrame(list(enumerate(map(float, row))), "position long, coefficient double")


def entries(features: FeatureModel, df: DataFrame, key: str) -> DataFrame:
    """(key, position, x): the numbers and the known categories of each row."""
    params = features.params_dict
    before, after = plain_columns(params, df.schema)
    placed, places = features.placed(df)
    at, parts = len(before), [F.struct(F.lit(i).cast("long").alias("position"), x.alias("x")) for i, (_, x) in enumerate(before)]
    for c, place in zip(params["categorical"], places):
        parts.append(F.struct((F.col(place) + at).alias("position"), F.lit(1.0).alias("x")))
        at += width(params, c)
    parts += [F.struct(F.lit(at + i).cast("long").alias("position"), x.alias("x")) for i, (_, x) in enumerate(after)]
    return placed.select(key, F.inline(F.array(*parts))).where(F.col("position").isNotNull())


@dataclass
class SparseAttribution:
    """``own``: (key, position, feature, value) of the rows' entries; ``rest``: (position, feature, value) of rows without one."""

    key: str
    own: DataFrame
    rest: DataFrame
    n_rows: int
    entries_per_row: int

    def global_importance(self) -> DataFrame:
        """(feature, mean_abs_shap), largest first."""
        sums = self.own.groupBy("position").agg(F.sum(F.abs("value")).alias("_s"), F.count("*").alias("_n"))
        total = F.coalesce("_s", F.lit(0.0)) + (self.n_rows - F.coalesce("_n", F.lit(0))) * F.abs("value")
        out = self.rest.join(sums, "position", "left").select("feature", (total / self.n_rows).alias("mean_abs_shap"))
        return out.orderBy(F.desc("mean_abs_shap"), "feature")

    def top_features(self, k: int = 10) -> DataFrame:
        """(key, feature, value, abs_value, rank): the k largest contributions of each row, ties by name."""

        def entry(value: Column) -> Column:
            return F.struct((-F.abs(value)).alias("minus"), F.col("feature").alias("feature"), value.alias("value"), F.col("position").alias("position"))

        # whatever entries a row has, k others are in this list
        others = self.rest.orderBy(F.desc(F.abs("value")), "feature").limit(k + self.entries_per_row)
        listed = others.agg(F.sort_array(F.collect_list(entry(F.col("value")))).alias("others"))
        rows = self.own.groupBy(self.key).agg(F.collect_list(entry(F.col("value"))).alias("mine"))  # entries_per_row each
        both = rows.join(F.broadcast(listed))  # one row
        taken = F.transform("mine", lambda e: e["position"])
        free = F.filter("others", lambda e: ~F.array_contains(taken, e["position"]))
        best = F.slice(F.sort_array(F.concat("mine", free)), 1, k)
        return both.select(self.key, F.posexplode(best).alias("pos", "e")).select(
            self.key, F.col("e.feature").alias("feature"), F.col("e.value").alias("value"),
            F.abs(F.col("e.value")).alias("abs_value"), (F.col("pos") + 1).alias("rank"),
        )


def linear_sparse(model: PipelineModel, df: DataFrame, key: str, class_index: int = 1) -> SparseAttribution:
    """Attribution of the margin of one class around the feature means of ``df``."""
    features: FeatureModel = model.stages[0]
    params = features.params_dict
    rows = entries(features, df, key)
    n_rows = df.count()
    sums = rows.groupBy("position").agg(F.sum("x").alias("_sum"))
    base = class_coefficients(model, class_index).join(sums, "position", "left").join(features.names(), "position")
    base = base.select("position", "feature", "coefficient", (F.coalesce("_sum", F.lit(0.0)) / max(n_rows, 1)).alias("mean"))
    # a row for each feature of the model, whose coefficients the driver holds
    wide = features.n_features * 64 > BROADCAST_BYTES
    joined = rows.join(base if wide else F.broadcast(base), "position")
    own = joined.select(key, "position", "feature", (F.col("coefficient") * (F.col("x") - F.col("mean"))).alias("value"))
    rest = base.select("position", "feature", (-F.col("coefficient") * F.col("mean")).alias("value"))
    before, after = plain_columns(params, df.schema)
    return SparseAttribution(key, own, rest, n_rows, len(before) + len(params["categorical"]) + len(after))


