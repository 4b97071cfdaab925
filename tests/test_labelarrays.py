"""Labels in arrays against one column per label, and their plans' width."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowcaster.operators import labelarrays as la
from rowcaster.operators import models, multilabel, rankmetrics, weights
from rowcaster.operators.features import FeatureModel, FeatureOptions, fit_features


def table(spark, n_labels, n=120, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=n)
    data = [(i, float(x[i]), [int(x[i] + r.normal() > j % 3 - 1) for j in range(n_labels)], r.integers(0, 2, n_labels).tolist(), r.random(n_labels).round(1).tolist()) for i in range(n)]
    return spark.createDataFrame(data, "id int, x double, truth array<int>, pred array<int>, score array<double>").repartition(3)


def test_equal_to_one_column_per_label(spark):
    df = table(spark, 3)
    wide = df.select("id", *[F.col(c)[j].alias(f"{c}{j}") for c in ("truth", "pred", "score") for j in range(3)])
    names = lambda c: [f"{c}{j}" for j in range(3)]
    want = multilabel.multilabel_metrics(wide, names("truth"), names("pred")).first()
    got = la.multilabel_metrics(df, "truth", "pred").first()
    assert all(math.isclose(got[c], want[c]) for c in ("macro_f1", "micro_f1", "samples_f1", "accuracy"))
    areas = lambda long: {r["cls"]: r["auc"] for r in rankmetrics.auc_by_class(long).collect()}
    assert areas(la.array_scores(df, "truth", "score")) == areas(rankmetrics.label_scores(wide, names("truth"), names("score")))
    mine = {r["id"]: r["weight"] for r in la.with_label_weight(df, "truth").collect()}
    theirs = {r["id"]: r["weight"] for r in weights.with_multilabel_weight(wide, names("truth")).collect()}
    assert mine.keys() == theirs.keys() and all(math.isclose(mine[i], theirs[i]) for i in mine)
    cut = df.select(la.decided("score", 0.5).alias("a"), la.decided("score", [0.1, 0.5, 0.9]).alias("b"), "score").collect()
    assert all(r["a"] == [int(s >= 0.5) for s in r["score"]] and r["b"] == [int(s >= t) for s, t in zip(r["score"], (0.1, 0.5, 0.9))] for r in cut)


def test_a_thousand_labels_in_a_plan_of_the_same_width(spark):
    sizes = []
    for n_labels in (2, 1000):
        df = table(spark, n_labels, 40)
        model = la.LabelArrayModel(FeatureModel(fit_features(df.select("id", "x"), FeatureOptions(), ["id"])[0]), [[0.5]] * n_labels, [0.0] * n_labels)
        frames = [la.multilabel_metrics(df, "truth", "pred"), la.array_scores(df, "truth", "score"), la.with_label_weight(df, "truth"), model.probabilities(df)]
        assert frames[0].first()["accuracy"] <= 1.0 and frames[1].count() == 40 * n_labels and frames[2].count() == 40
        assert all(len(r["proba"]) == n_labels for r in frames[3].collect())
        sizes.append([f._jdf.queryExecution().optimizedPlan().toString().count("\n") for f in frames])
    assert sizes[0] == sizes[1]


def test_models_equal_separate_fits(spark, tmp_path):
    df = table(spark, 3, 200)
    wide = df.select("id", "x", *[F.col("truth")[j].alias(f"y{j}") for j in range(3)])
    features = FeatureModel(fit_features(wide, FeatureOptions(), ["id", "y0", "y1", "y2"])[0])
    for imbalance in ({}, {"multilabel": True, "scheme": "inverse_freq"}):
        config = {"model": {"name": "logreg"}, "imbalance": imbalance}
        each = models.fit_multi_output(wide, features, config, ["y0", "y1", "y2"])
        want = {r["id"]: r["proba"] for r in models.multi_output_probabilities(each, wide).collect()}
        model = la.fit_label_arrays(df, features, config, "truth", 3)
        got = {r["id"]: r["proba"] for r in model.probabilities(df.select("id", "x")).collect()}
        assert all(np.allclose(got[i], want[i], atol=1e-6) for i in want)
    model.save(str(tmp_path / "m"))
    back = la.LabelArrayModel.load(spark, str(tmp_path / "m"))
    assert {r["id"]: r["proba"] for r in back.probabilities(df.select("id", "x")).collect()} == got
    with pytest.raises(ValueError, match="xgb"):
        la.fit_label_arrays(df, features, {"model": {"name": "xgb"}}, "truth", 3)
