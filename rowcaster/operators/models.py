"""Classifier construction and fitting on Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import current
from .boosting import BoostOptions, JointBooster
from .features import FeatureModel
from .weights import class_weights, positive_ratio, with_multilabel_weight

#: The option names of each kind of model.
LOGISTIC_NAMES = ("logistic", "logreg", "lr")
BOOSTED_NAMES = ("xgboost", "xgb")
FOREST_NAMES = ("forest", "rf")
MAX_ITERATIONS = 5000
DEEPEST = 30  # of a Spark tree; a forest without a depth grows to it


def family(config: dict) -> str:
    name = str(config.get("model", {}).get("name", "xgb")).lower()
    for kind, names in (
        ("logistic", LOGISTIC_NAMES), ("boosted", BOOSTED_NAMES), ("forest", FOREST_NAMES)
    ):
        if name in names:
            return kind
    raise ValueError(f"no kind of model is called {name}")


def logistic_estimator(config: dict, total_weight: float, **columns) -> LogisticRegression:
    """The penalty is relative to the summed loss, while Spark averages the loss."""
    options = config.get("model", {}).get("logistic", {})
    c = float(options.get("C", 1.0))
    penalty = options.get("penalty", "l2")
    if penalty not in ("l2", "none", None):
        raise ValueError(f"Unsupported penalty: {penalty}")
    reg = 1.0 / (c * total_weight) if penalty == "l2" else 0.0
    return LogisticRegression(
        family="auto", elasticNetParam=0.0, regParam=reg, standardization=False,
        maxIter=MAX_ITERATIONS, **columns,
    )


def boosting_params(options: dict, seed: int) -> dict:
    """Tree options under the names of Spark's own boosted classifier, which has no leaf penalties."""
    fraction = float(options.get("colsample_bytree", 1.0))
    return {
        "maxIter": int(options.get("n_estimators", 100)),
        "stepSize": float(options.get("learning_rate", 0.3)),
        "maxDepth": int(options.get("max_depth", 6)),
        "subsamplingRate": float(options.get("subsample", 1.0)),
        "featureSubsetStrategy": "all" if fraction >= 1.0 else str(fraction),
        "minInfoGain": float(options.get("gamma", 0.0)),
        "minInstancesPerNode": max(1, round(float(options.get("min_child_weight", 1.0)))),
        "seed": seed,
    }


def boosts_jointly(options: dict, n_classes: int) -> bool:
    """Spark's classifier knows two classes and no leaf penalties; all else is boosted here."""
    return n_classes > 2 or any(options.get(name) is not None for name in ("reg_lambda", "reg_alpha"))


def build_estimator(
    config: dict, n_classes: int, total_weight: float, label: str, weight: str | None = None, key: str | None = None
) -> Estimator:
    """The configured classifier over column ``features``."""
    seed = int(config.get("model", {}).get("random_state", 42))
    columns = {"featuresCol": "features", "labelCol": label}
    if weight is not None:
        columns["weightCol"] = weight
    kind = family(config)
    if kind == "logistic":
        return logistic_estimator(config, total_weight, **columns)
    if kind == "forest":
        options = config["model"].get("forest", {})
        return RandomForestClassifier(
            numTrees=int(options.get("n_estimators", 100)),
            maxDepth=min(DEEPEST, int(options.get("max_depth") or DEEPEST)), seed=seed, **columns,
        )
    options = config.get("model", {}).get("xgboost", {})
    if boosts_jointly(options, n_classes):
        return JointBooster(BoostOptions.of(options, seed), n_classes, label, weight, key)
    return GBTClassifier(**boosting_params(options, seed), **columns)


def marked_label(df: DataFrame, label: str, n_classes: int) -> DataFrame:
    """Tell the learners the number of classes, so that none has to count them."""
    meta = {"ml_attr": {"type": "nominal", "vals": [str(i) for i in range(n_classes)]}}
    return df.withColumn(label, F.col(label).cast("double").alias(label, metadata=meta))


def balanced_weight(label: str, counts: dict[int, int]) -> Column:
    """rows / (classes * rows of the class) from the class number; NULL has no weight."""
    table = class_weights(counts)
    weights = [table.get(i, 1.0) for i in range(max(counts) + 1)]
    i = F.col(label).cast("int")
    return F.when(i.isNotNull(), F.element_at(F.array(*[F.lit(w) for w in weights]), F.coalesce(i, F.lit(0)) + 1))


def uses_weights(config: dict, final_multiclass: bool) -> bool:
    """Logistic models are always balanced when enabled; trees only in the final multiclass fit."""
    imbalance = config.get("imbalance", {})
    if not imbalance.get("enable", True) or imbalance.get("scheme", "inverse_freq") == "none":
        return False
    return family(config) == "logistic" or final_multiclass


def fit_classifier(
    df: DataFrame,
    features: FeatureModel,
    config: dict,
    label: str,
    counts: dict[int, int],
    n_classes: int,
    weighted: bool,
    key: str | None = None,
) -> PipelineModel:
    """Fit on rows whose ``label`` holds class numbers with the given counts; ``key`` names a row."""
    total = float(sum(counts.values()))
    data = features.transform(df)
    kept = [label] if key is None else [label, key]
    if weighted:
        data = data.withColumn("_w", balanced_weight(label, counts))
        kept.append("_w")
    data = marked_label(data.select("features", *kept), label, n_classes)
    estimator = build_estimator(config, n_classes, total, label, "_w" if weighted else None, key)
    return PipelineModel([features, estimator.fit(data)])


def probabilities(model: Model, df: DataFrame, out: str = "proba") -> DataFrame:
    """``df`` plus the array of class probabilities."""
    scored = model.transform(df).withColumn(out, vector_to_array("probability"))
    return scored.select(*[F.col(f"`{c}`") for c in df.columns], out)


def fit_multi_output(
    df: DataFrame, features: FeatureModel, config: dict, labels: Sequence[str]
) -> list[PipelineModel]:
    """One independent binary model per 0/1 label column, on features computed once.

    ``imbalance.multilabel`` weighs rows by the classes they are positive in, and
    ``imbalance.pos_weight`` weighs the positive rows of each label by its negatives per
    positive; without them rows weigh alike.
    """
    options = config.get("imbalance", {})
    n = df.count()
    data = features.transform(df).select("features", *labels)
    if options.get("multilabel"):
        data = with_multilabel_weight(data, labels, options.get("scheme", "inverse_freq"), "_w")
    else:
        data = data.withColumn("_w", F.lit(1.0))
    data = data.persist()  # read by every pass of every fit
    weighted = bool(options.get("multilabel") or options.get("pos_weight"))
    models = []
    for c in labels:
        rows = data
        if options.get("pos_weight"):
            ratio = positive_ratio(data, c).first()["pos_weight"]
            rows = data.withColumn("_w", F.col("_w") * F.when(F.col(c) == 1, F.lit(float(ratio))).otherwise(F.lit(1.0)))
        estimator = build_estimator(config, 2, float(n), c, "_w" if weighted else None)
        models.append(PipelineModel([features, estimator.fit(marked_label(rows, c, 2))]))
    data.unpersist()
    return models


def multi_output_probabilities(models: Sequence[PipelineModel], df: DataFrame, out: str = "proba") -> DataFrame:
    """``df`` plus the array of positive probabilities, one entry per label."""
    data = models[0].stages[0].transform(df)
    parts = []
    for i, model in enumerate(models):
        last = model.stages[-1]
        last = last.copy({last.predictionCol: "", last.rawPredictionCol: "", last.probabilityCol: f"_p{i}"})
        data = last.transform(data)
        parts.append(vector_to_array(F.col(f"_p{i}"))[1])
    return data.withColumn(out, F.array(*parts)).select(*[F.col(f"`{c}`") for c in df.columns], out)


def native_importance(model: PipelineModel) -> DataFrame:
    """(feature, importance), largest first: tree importances or mean absolute coefficients."""
    features, last = model.stages[0], model.stages[-1]
    if hasattr(last, "featureImportances"):
        raw = last.featureImportances
        values = raw.toArray() if hasattr(raw, "toArray") else raw
    else:
        values = abs(last.coefficientMatrix.toArray()).mean(axis=0)
    rows = [(i, float(v)) for i, v in enumerate(values)]
    ranked = current().createDataFrame(rows, "position long, importance double")
    return ranked.join(features.names(), "position").select("feature", "importance").orderBy(F.desc("importance"), "feature")


def save_model(model: Model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
