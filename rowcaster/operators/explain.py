"""Feature attributions: exact for linear and tree models, sampled for any model."""

from __future__ import annotations

import json
import math
import random
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import Model, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .boosting import JointBoostingModel
from .select import row_lookup, sample_rows
from .trees import leaf_paths, node_table

BACKGROUND_ROWS = 100  # by default, as each permutation is scored for every row

# the batch function below is sent to the executors whole; they need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def listed(values: Sequence) -> Column:
    """A list as one constant, whatever its length."""
    kind = "array<string>" if values and isinstance(values[0], str) else "array<double>"
    return F.from_json(F.lit(json.dumps(list(values))), kind)


def to_long(df: DataFrame, key: str, values: str, names: Sequence[str]) -> DataFrame:
    """(key, feature, value, abs_value) from an attribution array."""
    entries = df.select(key, F.posexplode(values).alias("_at", "value"))
    return entries.select(key, F.element_at(listed(names), F.col("_at") + 1).alias("feature"), "value", F.abs("value").alias("abs_value"))


def linear_attribution(
    df: DataFrame, features: Sequence[Column], coefficients: Sequence[float], means: Sequence[float], out: str
) -> DataFrame:
    """coefficient * (value - mean), one projection."""
    parts = [F.lit(float(c)) * (x - F.lit(float(m))) for x, c, m in zip(features, coefficients, means)]
    return df.withColumn(out, F.array(*parts))


def linear_model_attribution(model: PipelineModel, df: DataFrame, class_index: int, out: str) -> DataFrame:
    """Attribution of the margin of one class around the feature means of ``df``, an entry for every feature.

    Means and coefficients, which the driver holds as it holds the model, are one constant
    each; ``sparse.linear_sparse`` writes out the entries that rows have alone.
    """
    last, data = model.stages[-1], model.stages[0].transform(df)
    means = data.agg(Summarizer.mean(F.col("features")).alias("m")).first()["m"]
    matrix = last.coefficientMatrix.toArray()
    row = matrix[0] if matrix.shape[0] == 1 else matrix[class_index]
    centred = F.zip_with(vector_to_array("features"), listed([float(m) for m in means]), lambda x, m: x - m)
    parts = F.zip_with(centred, listed([float(c) for c in row]), lambda x, c: c * x)
    return data.withColumn(out, parts).select(*[F.col(f"`{c}`") for c in df.columns], out)


# --- tree models ---------------------------------------------------------------------


def model_paths(model: Model, class_index: int) -> list[tuple[float, list]]:
    """(leaf value, [(feature, zero share, low, high), ...]) for every leaf of a forest (class share) or boosted model
    (margin of the class). The leaves are bounded by the model, not by the data."""
    rows = leaf_paths(node_table(model, class_index)).collect()
    return [(r["value"], [(e["feature"], e["share"], e["low"], e["high"]) for e in r["path"]]) for r in rows]


def path_attribution(x: np.ndarray, paths: list[tuple[float, list]], n_features: int) -> np.ndarray:
    """Path-dependent Shapley values of a sum of leaf paths, for a batch of rows.

    On one path with features P, a coalition reaches the leaf with the product over P of
    (inside its interval, if the feature is known) or (zero share, if not). The average
    over coalition sizes is read from the coefficients of the product over the other
    features of (zero share + inside * t).
    """
    out = np.zeros((len(x), n_features))
    for value, path in paths:
        d = len(path)
        if d == 0 or value == 0.0:
            continue
        z = [p[1] for p in path]
        inside = [((x[:, f] > lo) & (x[:, f] <= hi)).astype(float) for f, _, lo, hi in path]
        size_weight = [math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)]
        for i, (feature, *_) in enumerate(path):
            poly = np.zeros((d, len(x)))
            poly[0] = 1.0
            for j in range(d):
                if j != i:
                    poly[1:] = z[j] * poly[1:] + inside[j] * poly[:-1]
                    poly[0] *= z[j]
            weight = sum(w * c for w, c in zip(size_weight, poly))
            out[:, feature] += value * (inside[i] - z[i]) * weight
    return out


def tree_attribution(
    model: PipelineModel, df: DataFrame, key: str, class_index: int = 1, out: str = "attribution"
) -> DataFrame:
    """(key, attribution array); rows stay distributed, the leaf paths are broadcast.

    The paths are bounded by the model (trees x leaves), not by the data.
    """
    features, last = model.stages[0], model.stages[-1]
    n_features = features.n_features
    shared = df.sparkSession.sparkContext.broadcast(model_paths(last, class_index))
    data = features.transform(df).select(key, vector_to_array("features").alias("x"))

    def attribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_numpy())
                values = path_attribution(x, shared.value, n_features)
                yield pd.DataFrame({key: batch[key], out: list(values)})

    kind = df.schema[key].dataType.simpleString()
    return data.mapInPandas(attribute, f"`{key}` {kind}, {out} array<double>")


# --- any model -----------------------------------------------------------------------


def sampled_attribution(
    model: PipelineModel,
    df: DataFrame,
    key: str,
    class_index: int = 1,
    out: str = "attribution",
    permutations: int = 10,
    background: DataFrame | None = None,
    seed: int = 42,
    background_rows: int = BACKGROUND_ROWS,
) -> DataFrame:
    """(key, attribution array) by permutation sampling against background rows.

    Each row is scored along ``permutations`` random feature orders: features enter one by
    one, the rest stay at a background row. Values of a row add up to its probability
    minus the mean probability of the background rows used. The plan (at most
    ``background_rows`` rows, permutations x features numbers) is a literal.
    """
    features, last = model.stages[0], model.stages[-1]
    names = features.feature_names
    base = sample_rows(df if background is None else background, background_rows, key, seed)
    pool = [
        list(r["x"])
        for r in features.transform(base).select(vector_to_array("features").alias("x")).collect()
    ]
    rng, plan = random.Random(seed), []
    for _ in range(permutations):
        order = list(range(len(names)))
        rng.shuffle(order)
        place = [0] * len(names)
        for position, f in enumerate(order):
            place[f] = position
        plan.append((order, place, rng.choice(pool)))

    table = F.array(
        *[
            F.struct(
                F.array(*[F.lit(f) for f in order]).alias("order"),
                F.array(*[F.lit(p) for p in place]).alias("place"),
                F.array(*[F.lit(float(v)) for v in row]).alias("base"),
            )
            for order, place, row in plan
        ]
    )
    mixed = F.transform(
        F.col("x"), lambda v, i: F.when(F.col("m.place")[i] < F.col("step"), v).otherwise(F.col("m.base")[i])
    )
    points = (
        features.transform(df)
        .select(key, vector_to_array("features").alias("x"))
        .select(key, "x", F.explode(table).alias("m"))
        .select(key, "x", "m", F.explode(F.sequence(F.lit(0), F.lit(len(names)))).alias("step"))
        .select(key, "step", F.col("m.order").alias("order"), array_to_vector(mixed).alias("features"))
    )
    scored = last.transform(points).withColumn("p", vector_to_array("probability")[class_index])
    # the value at a step counts for the feature that just entered and against the next one
    signed = F.array(
        F.struct(F.get("order", F.col("step") - 1).alias("f"), F.col("p").alias("v")),
        F.struct(F.get("order", F.col("step")).alias("f"), (-F.col("p")).alias("v")),
    )
    total = (
        scored.select(key, F.inline(signed))
        .where(F.col("f").isNotNull())
        .groupBy(key, "f")
        .agg((F.sum("v") / F.lit(float(permutations))).alias("value"))
    )
    # a row has one value per feature, so the list is as long as the feature vector
    ordered = F.sort_array(F.collect_list(F.struct("f", "value")))
    return total.groupBy(key).agg(F.transform(ordered, lambda e: e["value"]).alias(out))


# --- choice, ranking, shapes -----------------------------------------------------------


def explainer_kind(model: PipelineModel) -> str:
    last = model.stages[-1]
    if hasattr(last, "trees") or isinstance(last, JointBoostingModel):
        return "tree"
    return "linear" if hasattr(last, "coefficientMatrix") else "sampled"


def attributions(
    model: PipelineModel, rows: DataFrame, key: str, class_index: int = 1, out: str = "attribution", seed: int = 42
) -> DataFrame:
    """(key, attribution array) of the given rows, by the method that fits the model."""
    kind = explainer_kind(model)
    if kind == "tree":
        return tree_attribution(model, rows, key, class_index, out)
    if kind == "linear":
        return linear_model_attribution(model, rows, class_index, out).select(key, out)
    return sampled_attribution(model, rows, key, class_index, out, seed=seed)


def explain(
    model: PipelineModel, df: DataFrame, key: str, class_index: int = 1, sample_size: int = 2000, seed: int = 42
) -> DataFrame:
    """Sample rows, then (key, feature, value, abs_value)."""
    rows = sample_rows(df, sample_size, key, seed)
    wide = attributions(model, rows, key, class_index, seed=seed)
    return to_long(wide, key, "attribution", model.stages[0].feature_names)


def global_importance(long: DataFrame) -> DataFrame:
    """(feature, mean_abs_shap), largest first."""
    return (
        long.groupBy("feature")
        .agg(F.avg("abs_value").alias("mean_abs_shap"))
        .orderBy(F.desc("mean_abs_shap"), "feature")
    )


def top_features(long: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k entries of each row with the largest absolute value, with their rank."""
    order = Window.partitionBy(key).orderBy(F.desc("abs_value"), "feature")
    return long.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_features_wide(df: DataFrame, key: str, values: str, names: Sequence[str], k: int = 10) -> DataFrame:
    """``top_features`` straight from the attribution array: sorted in the row, no shuffle."""

    def entry(v: Column, name: Column) -> Column:
        return F.struct((-F.abs(v)).alias("minus"), name.alias("feature"), v.alias("value"))

    labels = F.array(*[F.lit(n) for n in names])
    entries = F.transform(F.col(values), lambda v, i: entry(v, F.element_at(labels, i + 1)))
    best = F.slice(F.sort_array(entries), 1, k)
    return df.select(key, F.posexplode(best).alias("pos", "e")).select(
        key,
        F.col("e.feature").alias("feature"),
        F.col("e.value").alias("value"),
        F.abs(F.col("e.value")).alias("abs_value"),
        (F.col("pos") + 1).alias("rank"),
    )


def wide_attribution(long: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """``index`` and one column per feature, from the long form."""
    return (
        long.groupBy(F.col(key).alias("index"))
        .agg(*[F.sum(F.when(F.col("feature") == n, F.col("value"))).alias(n) for n in names])
    )


def wide_projection(df: DataFrame, key: str, values: str, names: Sequence[str]) -> DataFrame:
    """``index`` and one column per feature, from the array: a projection, no shuffle."""
    return df.select(F.col(key).alias("index"), *[F.col(values)[i].alias(n) for i, n in enumerate(names)])


def explain_row(long: DataFrame, key: str, value, k: int = 20) -> DataFrame:
    """(feature, value) of one row, largest absolute value first."""
    return (
        row_lookup(long, key, value)
        .orderBy(F.desc("abs_value"), "feature")
        .limit(k)
        .select("feature", F.col("value").alias("shap_value"))
    )
