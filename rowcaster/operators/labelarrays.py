"""Several 0/1 labels per row as arrays: metrics, weights, areas and models whose plans are as wide for a thousand labels as for two.

``truth`` and ``pred`` are arrays of 0 and 1, ``score`` an array of probabilities, all in the
same order of labels. Sums by label come from exploded (label, value) pairs that are combined
before the shuffle; what concerns a row stays in the row.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .confusion import ratio
from .features import FeatureModel
from .models import LOGISTIC_NAMES, build_estimator, marked_label
from .weights import check_scheme


def label_array(columns: Sequence[str]) -> Column:
    """The array of some 0/1 columns."""
    return F.array(*[F.col(f"`{c}`").cast("int") for c in columns])


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def label_pairs(df: DataFrame, **arrays: str) -> DataFrame:
    """(cls, the named values): a row for each label of each row."""
    zipped = F.arrays_zip(*[F.col(c).alias(n) for n, c in arrays.items()])
    return df.select(F.posexplode(zipped).alias("cls", "e")).select("cls", *[F.col("e")[n].alias(n) for n in arrays])


def multilabel_metrics(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row: macro_f1, micro_f1, samples_f1, accuracy (all labels of a row right)."""
    hits = _total(F.zip_with(truth, pred, lambda t, p: (t * p).cast("long")))
    sizes = _total(F.zip_with(truth, pred, lambda t, p: (t + p).cast("long")))
    right = F.forall(F.zip_with(truth, pred, lambda t, p: t == p), lambda x: x)
    rows = df.agg(F.avg(ratio(2.0 * hits, sizes)).alias("samples_f1"), F.avg(right.cast("double")).alias("accuracy"))
    pairs = label_pairs(df, t=truth, p=pred)
    each = pairs.groupBy("cls").agg(F.sum((F.col("t") * F.col("p")).cast("long")).alias("tp"), F.sum((F.col("t") + F.col("p")).cast("long")).alias("sz"))
    labels = each.agg(F.avg(ratio(2.0 * F.col("tp"), F.col("sz"))).alias("macro_f1"), ratio(2.0 * F.sum("tp"), F.sum("sz")).alias("micro_f1"))
    return labels.join(F.broadcast(rows)).select("macro_f1", "micro_f1", "samples_f1", "accuracy")  # one row and one row


def array_scores(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(cls, score, pos), for areas and precision by label."""
    pairs = label_pairs(df, t=truth, s=score)
    return pairs.select("cls", F.col("s").cast("double").alias("score"), F.col("t").cast("long").alias("pos"))


def decided(score: Column | str, thresholds: Sequence[float] | float) -> Column:
    """0/1 array; one threshold for all labels or one for each."""
    c = F.col(score) if isinstance(score, str) else score
    if isinstance(thresholds, float):
        return F.transform(c, lambda x: (x >= F.lit(thresholds)).cast("int"))
    return F.zip_with(c, constant(list(thresholds)), lambda x, t: (x >= t).cast("int"))


def constant(values: Sequence, kind: str = "array<double>") -> Column:
    """Numbers as one constant of the plan."""
    return F.from_json(F.lit(json.dumps(list(values))), kind)


def positives(df: DataFrame, truth: str) -> list[int]:
    """Rows with each label; the driver holds a number per label."""
    rows = label_pairs(df, t=truth).groupBy("cls").agg(F.sum("t").alias("n")).collect()
    found = {r["cls"]: int(r["n"]) for r in rows}
    return [found[i] for i in range(len(found))]


def with_label_weight(df: DataFrame, truth: str, scheme: str = "inverse_freq", out: str = "weight") -> DataFrame:
    """Mean weight of the row's positive labels (1.0 if none), rescaled to sum to the rows."""
    if scheme == "none":
        return df.withColumn(out, F.lit(1.0))
    check_scheme(scheme)
    n = df.count()
    if n == 0:
        return df.withColumn(out, F.lit(1.0))
    weights = constant([n / (2 * p + 1) for p in positives(df, truth)])
    active = _total(F.transform(truth, lambda t: (t == 1).cast("long")))
    held = F.aggregate(F.zip_with(truth, weights, lambda t, w: F.when(t == 1, w).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    raw = F.when(active > 0, held / active).otherwise(F.lit(1.0))
    total = df.agg(F.sum(raw)).first()[0]
    return df.withColumn(out, raw * F.lit(n / total))


@dataclass
class LabelArrayModel:
    """One logistic model per label, scored together."""

    features: FeatureModel
    coefficients: list[list[float]]
    intercepts: list[float]

    def probabilities(self, df: DataFrame, out: str = "proba") -> DataFrame:
        """``df`` plus the array of probabilities, an entry per label."""
        data = self.features.transform(df).withColumn("_x", vector_to_array("features"))
        models = constant([{"w": w, "b": b} for w, b in zip(self.coefficients, self.intercepts)], "array<struct<w:array<double>,b:double>>")
        margins = F.transform(models, lambda m: F.aggregate(F.zip_with("_x", m["w"], lambda x, w: x * w), m["b"], lambda a, x: a + x))
        return data.withColumn(out, F.transform(margins, lambda z: 1.0 / (1.0 + F.exp(-z)))).select(*[F.col(f"`{c}`") for c in df.columns], out)

    def save(self, path: str) -> None:
        self.features.write().overwrite().save(f"{path}/features")
        rows = [(i, w, b) for i, (w, b) in enumerate(zip(self.coefficients, self.intercepts))]
        spark = self.features.names().sparkSession
        spark.createDataFrame(rows, "label int, coefficients array<double>, intercept double").coalesce(1).write.mode("overwrite").parquet(f"{path}/labels")

    @staticmethod
    def load(spark: SparkSession, path: str) -> LabelArrayModel:
        rows = spark.read.parquet(f"{path}/labels").orderBy("label").collect()
        return LabelArrayModel(FeatureModel.load(f"{path}/features"), [list(r["coefficients"]) for r in rows], [r["intercept"] for r in rows])


def fit_label_arrays(df: DataFrame, features: FeatureModel, config: dict, truth: str, n_labels: int, parallelism: int = 4) -> LabelArrayModel:
    """One independent logistic model per label, several at a time, on features computed once.

    ``imbalance.multilabel`` weighs rows by the labels they are positive in. A label that no
    or every row has gets a constant of its share.
    """
    name = str(config.get("model", {}).get("name", "logreg")).lower()
    if name not in LOGISTIC_NAMES:
        raise ValueError(f"labels in arrays are fitted by logistic models, not by {name}")
    options = config.get("imbalance", {})
    data = features.transform(df).select("features", truth)
    weighted = bool(options.get("multilabel"))
    data = with_label_weight(data, truth, options.get("scheme", "inverse_freq"), "_w") if weighted else data
    data = data.persist()  # read by every pass of every fit
    n = data.count()

    def fit(i: int) -> tuple[list[float], float]:
        rows = marked_label(data.withColumn("_y", F.col(truth)[i]), "_y", 2)
        model = build_estimator(config, 2, float(n), "_y", "_w" if weighted else None).fit(rows)
        return [float(v) for v in model.coefficients], float(model.intercept)

    with ThreadPool(processes=max(1, parallelism)) as pool:
        fitted = pool.map(inheritable_thread_target(df.sparkSession)(fit), range(n_labels))
    data.unpersist()
    return LabelArrayModel(features, [w for w, _ in fitted], [b for _, b in fitted])
