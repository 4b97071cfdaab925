"""Probability calibration from out-of-fold scores, averaged over the folds."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import current
from .crossval import FoldedData
from .scores import ScoreTable, score_table

Scorer = Callable[[DataFrame, str, str], float]  # (frame, label column, probability array)


def decision_score(model: PipelineModel, df: DataFrame, out: str = "_score") -> DataFrame:
    """Margin of a logistic model, else the positive probability, beside the columns of ``df``."""
    scored = model.transform(df)
    margin = "rawPrediction" if hasattr(model.stages[-1], "coefficientMatrix") else "probability"
    value = vector_to_array(margin)[1]
    return scored.withColumn(out, value).select(*[F.col(f"`{c}`") for c in df.columns], out)


@dataclass
class Sigmoid:
    slope: float
    offset: float

    def apply(self, df: DataFrame, score: str, out: str) -> DataFrame:
        z = F.lit(self.slope) * F.col(score) + F.lit(self.offset)
        return df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))


@dataclass
class Isotonic:
    model: IsotonicRegressionModel

    def apply(self, df: DataFrame, score: str, out: str) -> DataFrame:
        m = self.model.copy({self.model.featuresCol: score, self.model.predictionCol: out})
        return m.transform(df)


def _merged(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row per distinct score: rows and positives. Ties collapse before the shuffle."""
    return df.groupBy(F.col(score).alias("s")).agg(
        F.count("*").cast("double").alias("n"), F.sum(F.col(label).cast("double")).alias("p")
    )


def fit_sigmoid(df: DataFrame, score: str, label: str) -> Sigmoid:
    """Sigmoid on smoothed targets, each target entering as two weighted rows."""
    return sigmoid_of(_merged(df, score, label))


def sigmoid_of(merged: DataFrame) -> Sigmoid:
    """The same from (s, n, p): rows and positives of each score."""
    totals = merged.agg(F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("n")).first()
    high = (totals["p"] + 1.0) / (totals["p"] + 2.0)
    low = 1.0 / (totals["n"] + 2.0)
    ones = F.col("p") * high + (F.col("n") - F.col("p")) * low
    sides = F.array(
        F.struct(F.lit(1.0).alias("y"), ones.alias("w")),
        F.struct(F.lit(0.0).alias("y"), (F.col("n") - ones).alias("w")),
    )
    rows = merged.select("s", F.inline(sides))
    data = rows.select(array_to_vector(F.array("s")).alias("features"), "y", "w")
    fitted = LogisticRegression(labelCol="y", weightCol="w", regParam=0.0, maxIter=1000, tol=1e-9).fit(data)
    return Sigmoid(float(fitted.coefficients[0]), float(fitted.intercept))


def fit_isotonic(df: DataFrame, score: str, label: str) -> Isotonic:
    """Monotone step fit, flat beyond the seen scores."""
    return isotonic_of(_merged(df, score, label))


def isotonic_of(merged: DataFrame) -> Isotonic:
    """The same from (s, n, p). The library pools neighbours within sorted partitions first; its last task then holds one
    row for each pooled block, at most one for each distinct score, some 40 bytes each (a million scores: 40 MB)."""
    data = merged.select("s", (F.col("p") / F.col("n")).alias("y"), "n")
    fitted = IsotonicRegression(featuresCol="s", labelCol="y", weightCol="n").fit(data)
    return Isotonic(fitted)


FITTERS = {"sigmoid": sigmoid_of, "isotonic": isotonic_of}


@dataclass
class CalibratedModel:
    """Mean over folds of (fold model, calibrator)."""

    method: str
    models: list[PipelineModel]
    calibrators: list

    def probabilities(self, df: DataFrame, out: str = "proba") -> DataFrame:
        data, parts = df, []
        for i, (model, calibrator) in enumerate(zip(self.models, self.calibrators)):
            data = decision_score(model, data, f"_s{i}")
            data = calibrator.apply(data, f"_s{i}", f"_c{i}")
            parts.append(F.col(f"_c{i}"))
        p = reduce(lambda a, b: a + b, parts) / F.lit(float(len(parts)))
        return data.withColumn(out, F.array(1.0 - p, p)).select(*[F.col(f"`{c}`") for c in df.columns], out)

    def save(self, path: str) -> None:
        info = {"method": self.method, "folds": len(self.models), "sigmoid": []}
        for i, (model, calibrator) in enumerate(zip(self.models, self.calibrators)):
            model.write().overwrite().save(f"{path}/fold_{i}")
            if isinstance(calibrator, Sigmoid):
                info["sigmoid"].append([calibrator.slope, calibrator.offset])
            else:
                calibrator.model.write().overwrite().save(f"{path}/isotonic_{i}")
        spark = current()
        spark.createDataFrame([(json.dumps(info),)], "value string").coalesce(1).write.mode(
            "overwrite"
        ).text(f"{path}/calibration")

    @staticmethod
    def load(path: str) -> CalibratedModel:
        info = json.loads(current().read.text(f"{path}/calibration").first()["value"])
        models = [PipelineModel.load(f"{path}/fold_{i}") for i in range(info["folds"])]
        if info["method"] == "sigmoid":
            calibrators = [Sigmoid(*pair) for pair in info["sigmoid"]]
        else:
            calibrators = [
                Isotonic(IsotonicRegressionModel.load(f"{path}/isotonic_{i}")) for i in range(info["folds"])
            ]
        return CalibratedModel(info["method"], models, calibrators)


def fit_calibrated(
    data: FoldedData, models: Sequence[PipelineModel], method: str, table: ScoreTable | None = None
) -> CalibratedModel:
    """One calibrator per fold, learned on the fold its model did not see."""
    if method not in FITTERS:
        raise ValueError(f"calibration methods are {', '.join(FITTERS)}; asked for: {method}")
    table = table or margin_table(fold_scores(data, models), data.label)
    calibrators = [FITTERS[method](table.merged(F.col("fold") == i)) for i in range(data.k)]
    return CalibratedModel(method, list(models), calibrators)


def fold_scores(data: FoldedData, models: Sequence[PipelineModel]) -> DataFrame:
    """(fold, _score, label): every row once, by the model that did not see it."""
    parts = [decision_score(m, data.test(i)).select("fold", "_score", data.label) for i, m in enumerate(models)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def margin_table(scores: DataFrame, label: str) -> ScoreTable:
    """The out-of-fold scores as a table by fold, from which calibrators of every method and fold are learned."""
    return score_table(scores.select("fold", F.lit(0).alias("cls"), F.col("_score").alias("score"), F.col(label).cast("long").alias("pos")))


def cross_calibrated(data: FoldedData, scores: DataFrame, method: str, table: ScoreTable) -> DataFrame:
    """Each row calibrated by a fit on the out-of-fold scores of the other folds."""
    parts = []
    for i in range(data.k):
        calibrator = FITTERS[method](table.merged(F.col("fold") != i))
        parts.append(calibrator.apply(scores.where(F.col("fold") == i), "_score", "_p"))
    frame = reduce(lambda a, b: a.unionByName(b), parts)
    return frame.select(data.label, F.array(1.0 - F.col("_p"), F.col("_p")).alias("proba"))


def select_calibration(
    data: FoldedData,
    models: Sequence[PipelineModel],
    methods: Iterable[str],
    scorer: Scorer,
    in_sample: bool = False,
) -> tuple[CalibratedModel, dict]:
    """Best method by score, the first on a tie, with all scores recorded.

    By default a row is judged by a model and a calibrator that both did not see it;
    ``in_sample`` judges the averaged model on all rows.
    """
    given = list(methods)
    methods = [m for i, m in enumerate(given) if m in FITTERS and m not in given[:i]]
    if not given or set(given) != set(methods):
        raise ValueError(f"calibration methods are {', '.join(FITTERS)}; asked for: {given or 'none'}")
    scores = fold_scores(data, models).persist()
    table = margin_table(scores, data.label)
    values: dict = {}
    for method in methods:
        if in_sample:
            frame = fit_calibrated(data, models, method, table).probabilities(data.df)
        else:
            frame = cross_calibrated(data, scores, method, table)
        frame = frame.select(data.label, "proba").persist()
        values[method] = float(scorer(frame, data.label, "proba"))
        frame.unpersist()
    scores.unpersist()
    best = max(methods, key=lambda m: values[m])
    return fit_calibrated(data, models, best, table), {**values, "selected": best}
