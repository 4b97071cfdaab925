"""Joint boosting against closed forms and plain loops."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from rowcaster.operators import explain, models, tune
from rowcaster.operators.boosting import BoostOptions, JointBooster, JointBoostingModel, settled, shrunk, structure


def table(spark, x, y, w=None):
    w = np.ones(len(y)) if w is None else w
    data = [(i, [float(v) for v in a], int(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, w))]
    return spark.createDataFrame(data, "id long, x array<double>, y int, w double").select("id", array_to_vector("x").alias("features"), "y", "w").repartition(3)


def scored(model, df):
    rows = model.transform(df).select("id", "probability", "rawPrediction").orderBy("id").collect()
    return np.array([r["probability"] for r in rows]), np.array([r["rawPrediction"] for r in rows])


@pytest.mark.parametrize("alpha,lam", [(0.0, 1.0), (1.5, 0.1), (4.0, 10.0)])
@pytest.mark.parametrize("n_classes", [2, 3])
def test_stump_equals_the_closed_form(spark, n_classes, alpha, lam):
    x = [[0.0]] * 20 + [[1.0]] * 30
    y = [0] * 15 + [1] * 5 + [n_classes - 1] * 22 + [0] * 8
    w = [1.0 + (i % 3) for i in range(50)]
    o = BoostOptions(n_estimators=1, learning_rate=0.5, max_depth=1, reg_alpha=alpha, reg_lambda=lam)
    df = table(spark, x, y, w)
    model = JointBooster(o, n_classes, "y", "w").fit(df)
    _, margins = scored(model, df)
    p0 = 1 / n_classes
    for c in range(n_classes):
        if n_classes == 2 and c == 0:
            continue
        leaves = [[i for i in range(50) if x[i][0] == side] for side in (0.0, 1.0)]
        sums = [(sum(w[i] * (p0 - (y[i] == c)) for i in rows), sum(w[i] * p0 * (1 - p0) * (1 if n_classes == 2 else 2) for i in rows)) for rows in leaves]
        whole = tuple(map(sum, zip(*sums)))
        score = [max(abs(g) - alpha, 0) ** 2 / (h + lam) for g, h in (*sums, whole)]
        for rows, own in zip(leaves, sums):
            g, h = own if score[0] + score[1] >= score[2] else whole  # a split that loses is taken back
            assert np.allclose(margins[rows, c], -0.5 * math.copysign(max(abs(g) - alpha, 0), g) / (h + lam), atol=1e-12)


def boost_brute(x, y, n_classes, o):
    """All rounds on one feature of two values, where every tree is the same split."""
    m = np.zeros((len(y), n_classes))
    for _ in range(o.n_estimators):
        e = np.exp(m - m.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        step = np.zeros_like(m)
        for c in range(n_classes):
            sides = [x[:, 0] == 0.0, x[:, 0] == 1.0, np.ones(len(y), bool)]
            sums = [((p[s, c] - (y[s] == c)).sum(), (2 * p[s, c] * (1 - p[s, c])).sum()) for s in sides]
            score = [shrunk(g, o.reg_alpha) ** 2 / (h + o.reg_lambda) for g, h in sums]
            kept = (0, 1) if score[0] + score[1] >= score[2] else (2,)
            for i in kept:
                step[sides[i], c] = -o.learning_rate * shrunk(sums[i][0], o.reg_alpha) / (sums[i][1] + o.reg_lambda)
        m += step
    return m


def test_many_rounds_over_a_cut(spark):
    r = np.random.default_rng(3)
    x = r.integers(0, 2, (200, 1)).astype(float)
    y = (r.integers(0, 3, 200) + (x[:, 0] > 0)) % 3
    o = BoostOptions(n_estimators=12, learning_rate=0.3, max_depth=1, reg_alpha=0.2, reg_lambda=1.0, min_child_weight=0.0)
    df = table(spark, x, y)
    p, margins = scored(JointBooster(o, 3, "y").fit(df), df)
    assert np.allclose(margins, boost_brute(x, y, 3, o), atol=1e-9)
    assert np.allclose(p.sum(axis=1), 1.0)


def test_rows_and_features_are_sampled_alike_on_every_run(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 6))
    y = (x[:, 0] + x[:, 1] > 0).astype(int) + (x[:, 2] > 0.5)
    o = BoostOptions(n_estimators=4, max_depth=3, subsample=0.6, colsample_bytree=0.5)
    df = table(spark, x, y)
    model = JointBooster(o, 3, "y", keyCol="id").fit(df)
    nodes = model.rows()
    assert nodes.query("node == 0")["rows"].between(180, 300).all()
    assert nodes.query("left >= 0").groupby(["round", "class"])["feature"].nunique().max() <= 3
    again = JointBooster(o, 3, "y", keyCol="id").fit(df.repartition(5, "id"))
    assert np.allclose(scored(model, df)[0], scored(again, df)[0], atol=1e-9)
    hits = (scored(model, df)[0].argmax(axis=1) == y).mean()
    assert hits > 0.75


def test_splits_are_taken_back():
    text = "tree\n If (feature 0 <= 0.5)\n  If (feature 1 <= 0.5)\n   Predict: 1.0\n  Else (feature 1 > 0.5)\n   Predict: 2.0\n Else (feature 0 > 0.5)\n  Predict: 3.0\n"
    assert structure(text, [4, 7])[:3] == ([1, 2, -1, -1, -1], [4, 3, -1, -1, -1], [4, 7, -1, -1, -1])
    leaves = {0: (3.0, 2.0, 5), 1: (2.9, 2.0, 5), 2: (-4.0, 3.0, 6)}
    tree, at = settled(text, None, leaves, BoostOptions(learning_rate=1.0, reg_lambda=0.0, min_child_weight=0.0))
    assert len(tree.left) == 5 and np.allclose(at, [-1.5, -1.45, 4 / 3])
    gain = 3.0**2 / 2 + 2.9**2 / 2 - 5.9**2 / 4
    assert math.isclose(tree.gain[1], gain)
    for o in (BoostOptions(gamma=2 * gain, learning_rate=1.0, reg_lambda=0.0), BoostOptions(min_child_weight=2.5, learning_rate=1.0, reg_lambda=0.0)):
        tree, at = settled(text, None, leaves, o)  # the inner split goes, its rows share a leaf
        assert len(tree.left) == 3 and np.allclose(at, [-5.9 / 4, -5.9 / 4, 4 / 3])
        assert tree.left.tolist() == [1, -1, -1] and tree.right.tolist() == [2, -1, -1]
    tree, at = settled(text, None, leaves, BoostOptions(gamma=1e9, learning_rate=1.0, reg_lambda=0.0))
    assert len(tree.left) == 1 and np.allclose(at, -1.9 / 7)


def test_saved_and_explained(spark, tmp_path):
    r = np.random.default_rng(8)
    x = r.normal(size=(150, 3))
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.3)
    df = table(spark, x, y)
    model = JointBooster(BoostOptions(n_estimators=3, max_depth=2), 3, "y").fit(df)
    model.write().save(str(tmp_path / "m"))
    back = JointBoostingModel.load(str(tmp_path / "m"))
    assert (scored(back, df)[1] == scored(model, df)[1]).all()
    assert math.isclose(back.featureImportances.sum(), 1.0) and back.featureImportances[2] < 0.2
    for c in range(3):  # the paths lead every row to its margin
        paths = explain.model_paths(back, c)
        want = [sum(v for v, path in paths if all(lo < row[f] <= hi for f, _, lo, hi in path)) for row in x]
        assert np.allclose(scored(model, df)[1][:, c], want)


def test_every_range_of_the_search_is_accepted(spark):
    import random

    r = np.random.default_rng(9)
    x = r.normal(size=(120, 2))
    df = table(spark, x, (x[:, 0] > 0).astype(int))
    ranges = tune.search_space({"model": {"name": "xgb"}})[1]
    assert len(ranges) == 9
    options = tune.draw(ranges, random.Random(1)) | {"n_estimators": 2}
    learner = models.build_estimator({"model": {"name": "xgb", "xgboost": options}}, 2, 120.0, "y")
    assert isinstance(learner, JointBooster) and all(getattr(learner.options, k) == v for k, v in options.items())
    p, _ = scored(learner.fit(df), df)
    assert np.allclose(p.sum(axis=1), 1.0)


def test_no_rows_and_one_class(spark):
    df = table(spark, np.zeros((4, 1)), [1, 1, 1, 1])
    empty = JointBooster(BoostOptions(n_estimators=2), 3, "y").fit(df.limit(0))
    assert np.allclose(scored(empty, df)[0], 1 / 3)
    p, _ = scored(JointBooster(BoostOptions(n_estimators=2), 2, "y").fit(df), df)
    assert (p[:, 1] > 0.5).all()
    assert df.where(F.col("y") > 1).count() == 0
