import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from rowcaster.functions import ranking
from rowcaster.operators import calibrate, crossval, explain, metrics, models, scoring, tune
from rowcaster.operators.features import FeatureModel, FeatureOptions, fit_features
from rowcaster.operators.folds import group_class_folds, group_folds, stratified_folds, stratified_holdout
from rowcaster.operators.select import class_counts, rank_by_unit, sample_rows
from rowcaster.functions.hashing import unit_hash

PLAIN = FeatureOptions(scaler="none")
LOGISTIC = {"model": {"name": "logreg"}, "imbalance": {"enable": False}}
BOOSTED = {"model": {"name": "xgb", "xgboost": {"n_estimators": 6, "max_depth": 3}}}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    x, z = rng.normal(size=240), rng.normal(size=240)
    y = (x - 0.5 * z + rng.normal(size=240) > 0.4).astype(int)
    c = np.clip((x + z + 1.5).astype(int), 0, 2)
    data = [(i, float(a), float(b), "uv"[i % 2], int(t), int(k)) for i, (a, b, t, k) in enumerate(zip(x, z, y, c))]
    return spark.createDataFrame(data, "id int, x double, z double, s string, y int, c int").repartition(3).persist()


def fit(df, config, label="y", n=2, weighted=False, options=PLAIN):
    state = fit_features(df, options, ["id", "y", "c"])[0]
    return models.fit_classifier(df, FeatureModel(state), config, label, class_counts(df, label), n, weighted)


def newton(x, y, w, c):
    """Penalised logistic regression with a free intercept."""
    a = np.column_stack([np.ones(len(x)), x])
    beta, ridge = np.zeros(a.shape[1]), np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ beta))
        gradient = c * a.T @ (w * (p - y)) + ridge @ beta
        hessian = c * (a * (w * p * (1 - p))[:, None]).T @ a + ridge
        beta -= np.linalg.solve(hessian, gradient)
    return beta


@pytest.mark.parametrize("c", [0.1, 1.0])
@pytest.mark.parametrize("weighted", [False, True])
def test_logistic_penalty_scale(rows, c, weighted):
    model = fit(rows, {"model": {"name": "lr", "logistic": {"C": c}}}, weighted=weighted)
    data = model.stages[0].transform(rows).select(vector_to_array("features").alias("f"), "y").collect()
    x, y = np.array([r["f"] for r in data]), np.array([r["y"] for r in data])
    n, pos = len(y), y.sum()
    w = np.where(y == 1, n / (2 * pos), n / (2 * (n - pos))) if weighted else np.ones(n)
    want = newton(x, y, w, c)
    got = model.stages[1]
    assert np.allclose([got.intercept, *got.coefficients], want, atol=2e-4)


def test_model_names(rows):
    assert [models.family({"model": {"name": n}}) for n in ("XGB", "lr", "rf")] == ["boosted", "logistic", "forest"]
    with pytest.raises(ValueError, match="no kind of model"):
        models.family({"model": {"name": "svm"}})
    assert models.boosting_params({"colsample_bytree": 0.5}, 1)["featureSubsetStrategy"] == "0.5"
    assert [models.boosts_jointly(o, k) for o, k in (({}, 2), ({}, 3), ({"reg_lambda": 2.0}, 2), ({"reg_alpha": 0.0}, 2))] == [False, True, True, True]


def test_boosted_classes_are_saved(spark, rows, tmp_path):
    model = fit(rows, BOOSTED, "c", 3)
    before = models.probabilities(model, rows).select("id", "proba").orderBy("id").collect()
    assert all(math.isclose(sum(r["proba"]), 1.0) for r in before)
    models.save_model(model, str(tmp_path / "m"))
    after = models.probabilities(models.load_model(str(tmp_path / "m")), rows).select("id", "proba")
    assert after.orderBy("id").collect() == before
    importance = models.native_importance(model).collect()
    assert math.isclose(sum(r["importance"] for r in importance), 1.0)
    hits = models.probabilities(model, rows).select((ranking.argmax_index("proba") == F.col("c")).cast("int").alias("h"))
    assert hits.agg(F.avg("h")).first()[0] > 0.7


def enumerate_shapley(paths, x, d):
    """Shapley values of the path-dependent tree expectation by listing all coalitions."""
    def value(known):
        total = 0.0
        for leaf, path in paths:
            reach = 1.0
            for f, z, lo, hi in path:
                reach *= float(lo < x[f] <= hi) if f in known else z
            total += leaf * reach
        return total

    out = np.zeros(d)
    for i in range(d):
        others = [j for j in range(d) if j != i]
        for k in range(d):
            share = math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d)
            for s in itertools.combinations(others, k):
                out[i] += share * (value({*s, i}) - value(set(s)))
    return out


@pytest.mark.parametrize("kind", ["boosted", "forest", "classes"])
def test_tree_attribution_by_enumeration(rows, kind):
    config = {"model": {"name": "rf", "forest": {"n_estimators": 4, "max_depth": 5}}} if kind == "forest" else BOOSTED
    model = fit(rows, config, *(("c", 3) if kind == "classes" else ("y", 2)))
    paths = explain.model_paths(model.stages[1], 1)
    data = model.stages[0].transform(rows.where("id < 12")).select("id", vector_to_array("features").alias("f"))
    x = {r["id"]: r["f"] for r in data.collect()}
    got = explain.tree_attribution(model, rows.where("id < 12"), "id").collect()
    assert len(got) == 12
    for r in got:
        assert np.allclose(r["attribution"], enumerate_shapley(paths, x[r["id"]], 4), atol=1e-9)


def test_tree_leaves_reproduce_the_forest(rows):
    model = fit(rows, {"model": {"name": "rf", "forest": {"n_estimators": 5, "max_depth": 4}}})
    paths = explain.model_paths(model.stages[1], 1)
    scored = models.probabilities(model, rows).select("id", "x", "z", "proba")
    vectors = model.stages[0].transform(rows).select("id", vector_to_array("features").alias("f"))
    for r in scored.join(vectors, "id").limit(20).collect():
        total = sum(v for v, p in paths if all(lo < r["f"][f] <= hi for f, _, lo, hi in p))
        assert math.isclose(total, r["proba"][1], abs_tol=1e-12)


def test_linear_attribution_sums_to_margin(rows):
    model = fit(rows, LOGISTIC)
    wide = explain.attributions(model, rows, "id")
    margin = model.transform(rows).select("id", vector_to_array("rawPrediction")[1].alias("m"))
    total = F.aggregate("attribution", F.lit(0.0), lambda a, b: a + b)
    rest = wide.join(margin, "id").select((F.col("m") - total).alias("r")).agg(F.min("r"), F.max("r")).first()
    assert math.isclose(rest[0], rest[1], abs_tol=1e-9)


def test_sampled_attribution_adds_up(rows):
    """Row totals equal its probability less the mean over the background rows drawn."""
    model = fit(rows, LOGISTIC)
    few = rows.where("id < 10")
    out = explain.sampled_attribution(model, few, "id", permutations=4, background=rows)
    again = explain.sampled_attribution(model, few.repartition(5), "id", permutations=4, background=rows)
    total = F.aggregate("attribution", F.lit(0.0), lambda a, b: a + b)
    p = models.probabilities(model, few).select("id", F.col("proba")[1].alias("p"))
    rest = [r[0] for r in out.join(p, "id").select(F.col("p") - total).collect()]
    assert len(rest) == 10 and max(rest) - min(rest) < 1e-9
    a = {r["id"]: r["attribution"] for r in out.collect()}
    b = {r["id"]: r["attribution"] for r in again.collect()}
    assert all(np.allclose(a[i], b[i]) for i in a)


def test_shapes_of_attributions(spark):
    names = ["p", "q", "r"]
    df = spark.createDataFrame([(1, [0.5, -2.0, 0.5]), (2, [0.0, 0.1, -0.3])], "id int, attribution array<double>")
    long = explain.to_long(df, "id", "attribution", names)
    assert [tuple(r) for r in explain.global_importance(long).collect()] == [("q", 1.05), ("r", 0.4), ("p", 0.25)]
    a = explain.top_features(long, "id", 2).select("id", "feature", "value", "abs_value", "rank")
    b = explain.top_features_wide(df, "id", "attribution", names, 2)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    one = explain.wide_attribution(long, "id", names).orderBy("index").collect()
    assert one == explain.wide_projection(df, "id", "attribution", names).orderBy("index").collect()
    assert [r["feature"] for r in explain.explain_row(long, "id", 1).collect()] == ["q", "p", "r"]


# --- folds and sampling --------------------------------------------------------------


def test_folds_are_balanced_and_stable(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(301)], "id int, y string")
    folded = stratified_folds(df, "y", "id", 4)
    sizes = folded.groupBy("y", "fold").count().collect()
    for y in "ab":
        n = [r["count"] for r in sizes if r["y"] == y]
        assert len(n) == 4 and max(n) - min(n) <= 1
    assert sorted(folded.collect()) == sorted(stratified_folds(df.repartition(9), "y", "id", 4).collect())
    train, test = stratified_holdout(df, "y", "id")
    assert train.count() + test.count() == 301 and test.count() in (60, 61, 62)
    with pytest.raises(ValueError, match="fewer than 5 rows"):
        stratified_folds(df.limit(2), "y", "id", 5)


def test_rank_does_not_depend_on_ranges(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(500)], "id int, g int")
    whole = rank_by_unit(df, "g", unit_hash("id"), "id", "r").collect()
    cut = rank_by_unit(df, "g", unit_hash("id"), "id", "r", rows_per_bucket=20).collect()
    assert sorted(whole) == sorted(cut)


def test_groups_stay_together(spark):
    df = spark.createDataFrame([(i, i % 20) for i in range(200)], "id int, g int")
    assert group_folds(df, "g", 3).groupBy("g").agg(F.count_distinct("fold").alias("n")).agg(F.max("n")).first()[0] == 1


@pytest.mark.parametrize("n", [0, 1, 37, 999, 1000, 5000])
def test_sample_size_and_content(spark, n):
    df = spark.range(1000).withColumnRenamed("id", "k")
    got = sorted(r["k"] for r in sample_rows(df, n, "k", 7).collect())
    order = [r["k"] for r in df.orderBy(unit_hash("k", seed=7), "k").collect()]
    assert got == sorted(order[:n])


# --- cross-validation, calibration, search -----------------------------------------------


@pytest.fixture(scope="module")
def folded(rows):
    return crossval.prepare_folds(rows.drop("c"), PLAIN, "y", "id", 2, 3)


@pytest.fixture(scope="module")
def fold_models(folded):
    return crossval.fit_folds(folded, LOGISTIC)


def test_each_row_is_scored_by_the_model_that_did_not_see_it(rows, folded, fold_models):
    scored = {r["id"]: r for r in crossval.out_of_fold(folded, fold_models).collect()}
    assert len(scored) == rows.count()
    for i, model in enumerate(fold_models):
        own = models.probabilities(model, folded.test(i)).collect()
        assert all(r["proba"] == scored[r["id"]]["proba"] for r in own)


def test_rare_class_keeps_the_vector_length(spark):
    df = spark.createDataFrame([(i, float(i % 7), 2 if i == 0 else i % 2) for i in range(40)], "id int, x double, y int")
    data = crossval.prepare_folds(df, PLAIN, "y", "id", 3, 2)
    scored = crossval.out_of_fold(data, crossval.fit_folds(data, LOGISTIC))
    assert {len(r["proba"]) for r in scored.collect()} == {3}


def platt(s, y):
    """Sigmoid fit by Newton steps on smoothed targets."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, beta = np.column_stack([s, np.ones(len(s))]), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-a @ beta))
        beta -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a, a.T @ (p - t))
    return beta


def test_sigmoid_against_newton(spark):
    rng = np.random.default_rng(8)
    s = np.round(rng.normal(size=300), 1)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * s + 0.5))).astype(int)
    df = spark.createDataFrame(list(zip(s.tolist(), y.tolist())), "s double, y int")
    got = calibrate.fit_sigmoid(df, "s", "y")
    assert np.allclose([got.slope, got.offset], platt(s, y), atol=1e-4)


def test_isotonic_is_monotone_and_flat_outside(spark):
    data = [(0.1, 0), (0.2, 1), (0.3, 0), (0.4, 1), (0.4, 1), (0.9, 1)]
    df = spark.createDataFrame(data, "s double, y int")
    fitted = calibrate.fit_isotonic(df, "s", "y")
    probe = spark.createDataFrame([(v,) for v in (-1.0, 0.1, 0.25, 0.4, 2.0)], "s double").coalesce(1)
    got = [r["p"] for r in fitted.apply(probe, "s", "p").collect()]
    assert got == [0.0, 0.0, 0.5, 1.0, 1.0]


def test_calibration_choice_and_save(spark, rows, folded, fold_models, tmp_path):
    best, scores = calibrate.select_calibration(
        folded, fold_models, ["isotonic", "sigmoid", "isotonic"], metrics.scorer("roc_auc")
    )
    assert list(scores) == ["isotonic", "sigmoid", "selected"] and best.method == scores["selected"]
    assert scores[best.method] == max(scores["isotonic"], scores["sigmoid"])
    inside = calibrate.select_calibration(folded, fold_models, ["sigmoid"], lambda d, y, p: 1.0, in_sample=True)
    assert inside[1] == {"sigmoid": 1.0, "selected": "sigmoid"}
    for method in ("sigmoid", "isotonic"):
        model = calibrate.fit_calibrated(folded, fold_models, method)
        model.save(str(tmp_path / method))
        back = calibrate.CalibratedModel.load(str(tmp_path / method))
        a = model.probabilities(rows).select("id", "proba").orderBy("id").collect()
        b = back.probabilities(rows).select("id", "proba").orderBy("id").collect()
        assert a == b and all(math.isclose(sum(r["proba"]), 1.0) for r in a)
    with pytest.raises(ValueError, match="calibration methods are"):
        calibrate.select_calibration(folded, fold_models, [], metrics.scorer("roc_auc"))
    with pytest.raises(ValueError, match="calibration methods are"):
        calibrate.select_calibration(folded, fold_models, ["beta"], metrics.scorer("roc_auc"))


def test_search(folded):
    best, trials = tune.random_search(folded, LOGISTIC, "macro_f1", n_trials=3, seed=1)
    lines = trials.collect()
    assert [r["value"] for r in lines] == sorted((r["value"] for r in lines), reverse=True)
    assert lines[0]["params_C"] == best["C"] and all(1e-3 <= r["params_C"] <= 10 for r in lines)
    short = tune.random_search(folded, LOGISTIC, n_trials=50, timeout_seconds=0.0)[1]
    assert short.count() == 1
    with pytest.raises(ValueError, match="forest"):
        tune.search_space({"model": {"name": "rf"}})


# --- output tables ---------------------------------------------------------------------


def test_ties_go_to_the_lower_class(spark):
    df = spark.createDataFrame([([0.5, 0.5],), ([0.2, 0.8],)], "p array<double>").coalesce(1)
    top = scoring.topk_output(df, "p", ["a", "b"], 5).collect()
    assert [r["prediction"] for r in top] == ["a", "b"] and [r["top1_disease"] for r in top] == ["a", "b"]
    assert scoring.topk_output(df, "p", ["a", "b"], 5).columns == [
        "prediction", "top1_disease", "top1_probability", "top2_disease", "top2_probability"
    ]
    assert [r["prediction"] for r in scoring.multiclass_output(df, "p", 2).collect()] == [0, 1]


def test_bands_and_captions(spark):
    df = spark.createDataFrame([([1 - p, p],) for p in (0.9, 0.7, 0.5, 0.2)], "p array<double>").coalesce(1)
    out = scoring.binary_output(df, "p", 0.5, bands=True).collect()
    assert [r["prediction"] for r in out] == [1, 1, 1, 0]
    assert [r["risk_level"].split(" ", 1)[1] for r in out] == ["HIGH RISK", "MODERATE RISK", "POSITIVE", "NEGATIVE"]
    captions = [r["disease"] for r in scoring.caption_output(df, "p", 2).collect()]
    assert captions == ["Disease Detected", "Disease Detected", "Healthy", "Healthy"]
    assert scoring.resolve_threshold(None, None) == 0.5
    assert scoring.resolve_threshold(None, 0.3) == 0.3 and scoring.resolve_threshold(0.0, 0.3) == 0.0


@pytest.mark.parametrize("groups", [6, 40, 2000])
def test_folds_by_group_and_class(spark, groups):
    """Groups stay whole; a hot group, rare classes and gaps; class shares within the stated bound."""
    rng = np.random.default_rng(groups)
    data = []
    for i in range(4000):
        g = 0 if i % 3 == 0 else int(rng.integers(groups))
        data.append((i, None if g == 1 else f"g{g}", [None, "a", "b", "c"][min(3, int(rng.exponential(1.2)))] if g % 2 else "ab"[int(rng.random() < 0.3)]))
    df = spark.createDataFrame(data, "id int, g string, y string").repartition(3)
    for k in (2, 3):
        rows = group_class_folds(df, "y", "g", k).collect()
        again = {r["id"]: r["fold"] for r in group_class_folds(df.repartition(7), "y", "g", k).collect()}
        assert len(rows) == 4000 and all(again[r["id"]] == r["fold"] for r in rows)
        owner = {}
        for r in rows:
            assert owner.setdefault(r["g"], r["fold"]) == r["fold"] and 0 <= r["fold"] < k
        for y in {r["y"] for r in rows}:
            mine = [r for r in rows if r["y"] == y]
            largest = max(sum(r["g"] == g for r in mine) for g in {r["g"] for r in mine})
            for f in range(k):
                off = abs(sum(r["fold"] == f for r in mine) / len(mine) - 1 / k)
                assert off <= largest / len(mine) + 3 / math.sqrt(max(1, len(mine)))
    assert group_class_folds(df.limit(0), "y", "g", 3).collect() == []


def test_folds_of_a_training_table_keep_groups(spark, rows):
    data = crossval.prepare_folds(rows.withColumn("g", F.col("id") % 12), PLAIN, "y", "id", 2, 3, group="g", exclude=["g", "c"])
    assert data.df.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    shares = data.df.groupBy("fold").agg(F.avg("y").alias("y"), F.count("*").alias("n")).collect()
    assert len(shares) == 3 and max(r["n"] for r in shares) - min(r["n"] for r in shares) <= 40
