"""Seeded random search over fixed ranges, scored out of fold."""

from __future__ import annotations

import copy
import math
import random
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import argmax_index
from .crossval import FoldedData, fit_folds, out_of_fold
from .metrics import generic_metric
from .models import family

# Search ranges (kind, low, high).
BOOSTED_RANGES = {
    "n_estimators": ("int", 200, 800),
    "learning_rate": ("log", 0.01, 0.3),
    "max_depth": ("int", 3, 10),
    "subsample": ("float", 0.6, 1.0),
    "colsample_bytree": ("float", 0.5, 1.0),
    "gamma": ("float", 0.0, 5.0),
    "min_child_weight": ("float", 1.0, 10.0),
    "reg_lambda": ("log", 0.1, 10.0),
    "reg_alpha": ("log", 1e-8, 1.0),
}
LOGISTIC_RANGES = {"C": ("log", 1e-3, 10.0)}


def search_space(config: dict) -> tuple[str, dict]:
    kind = family(config)
    if kind == "boosted":
        return "xgboost", BOOSTED_RANGES
    if kind == "logistic":
        return "logistic", LOGISTIC_RANGES
    raise ValueError(f"a {kind} model has no ranges to search")


def draw(ranges: dict, rng: random.Random) -> dict:
    out = {}
    for name, (kind, low, high) in ranges.items():
        if kind == "int":
            out[name] = rng.randint(low, high)
        elif kind == "log":
            out[name] = math.exp(rng.uniform(math.log(low), math.log(high)))
        else:
            out[name] = rng.uniform(low, high)
    return out


def random_search(
    data: FoldedData,
    config: dict,
    metric: str = "roc_auc",
    n_trials: int = 30,
    timeout_seconds: float | None = 900.0,
    seed: int = 42,
    ranges: dict | None = None,
    parallelism: int = 2,
) -> tuple[dict, DataFrame]:
    """(best parameters, trials). Features and folds are learned once for all trials."""
    section, shipped = search_space(config)
    rng, started, rows = random.Random(seed), time.monotonic(), []
    for number in range(n_trials):
        if rows and timeout_seconds is not None and time.monotonic() - started > timeout_seconds:
            break
        params = draw(ranges or shipped, rng)
        trial = copy.deepcopy(config)
        trial.setdefault("model", {}).setdefault(section, {}).update(params)
        models = fit_folds(data, trial, parallelism=parallelism)
        scored = out_of_fold(data, models).select(data.label, "proba").withColumn("_p", argmax_index("proba"))
        scored = scored.persist()
        value = generic_metric(scored, data.label, "_p", "proba", data.n_classes, metric)
        scored.unpersist()
        rows.append((number, -math.inf if value is None else float(value), params))
    spark = data.df.sparkSession
    names = list((ranges or shipped).keys())
    table = spark.createDataFrame(
        [(n, v, *[float(p[c]) for c in names]) for n, v, p in rows],
        ", ".join(["number int", "value double", *[f"params_{c} double" for c in names]]),
    )
    best = max(rows, key=lambda r: (r[1], -r[0]))[2]
    return best, table.orderBy(F.desc("value"), "number")
