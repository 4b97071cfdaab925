import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from rowcaster.functions import scalar
from rowcaster.operators import dictionary, explain, features, labels, models, sparse, weights
from rowcaster.operators.features import FeatureBuilder, FeatureModel, FeatureOptions, fit_features
from rowcaster.operators.select import column_roles, drop_leakage, leakage_columns


def values(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_bins_at_the_edges(spark):
    ages = [-1.0, 0.0, 29.0, 30.0, 44.0, 45.0, 59.0, 60.0, 119.0, 120.0]
    df = spark.createDataFrame([(a,) for a in ages], "age double").coalesce(1)
    assert values(df, scalar.bin_index("age")) == [0, 1, 1, 2, 2, 3, 3, 4, 4, 5]
    assert values(df, scalar.bin_index("age")) == np.digitize(ages, [0, 30, 45, 60, 120]).tolist()


def test_all_null_columns_tie_and_constant(spark):
    rows = [(None, None, "a", 5.0), (None, None, "a", 5.0), (None, None, "b", 5.0), (None, None, "b", None)]
    df = spark.createDataFrame(rows, "n double, s string, t string, c double")
    state = fit_features(df, FeatureOptions())[0]
    assert state["all_null"] == ["n"] and state["numeric"] == ["c"]
    assert state["modes"] == {"s": "missing", "t": "a"}
    assert features.category_lists(state) == {"s": ["missing"], "t": ["a", "b"]}
    assert state["stds"]["c"] == 1.0
    scaled = dict(features.feature_columns(state, df.schema))
    assert values(df, scaled["c"]) == [0.0] * 4
    assert values(df, scaled["s_missing"]) == [1.0] * 4


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "x double")
    state = fit_features(df, FeatureOptions(missing_count=True))[0]
    assert state["medians"]["x"] == 2.0
    named = dict(features.feature_columns(state, df.schema))
    assert sorted(values(df, named["missing_count"])) == [0.0, 0.0, 1.0, 1.0]
    assert math.isclose(state["stds"]["x"], np.std([1, 2, 3, 2]))


def test_unknown_category_is_all_zero(spark):
    train = spark.createDataFrame([("M", 1.0), ("F", 2.0)], "sex string, x double")
    model = FeatureBuilder(options=FeatureOptions()).fit(train)
    score = spark.createDataFrame([("Male", 1.0), ("M", 1.0)], "sex string, x double")
    out = {r["sex"]: list(r["v"]) for r in model.transform(score).select("sex", vector_to_array("features").alias("v")).collect()}
    assert model.feature_names == ["x", "sex_F", "sex_M"]
    assert out["Male"][1:] == [0.0, 0.0] and out["M"][1:] == [0.0, 1.0]


def test_moments_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = [None if rng.random() < 0.2 else float(v) for v in rng.normal(1e4, 3, 500)]
    df = spark.createDataFrame([(v,) for v in x], "x double").repartition(4)
    state = fit_features(df, FeatureOptions())[0]
    median = float(np.median([v for v in x if v is not None]))
    filled = [median if v is None else v for v in x]
    assert state["medians"]["x"] == median
    assert math.isclose(state["means"]["x"], np.mean(filled), rel_tol=1e-12)
    assert math.isclose(state["stds"]["x"], np.std(filled), rel_tol=1e-9)


def test_folds_learned_together_equal_separate_fits(spark):
    rng = np.random.default_rng(4)
    rows = [
        (i % 3, None if rng.random() < 0.1 else float(rng.normal()), None if rng.random() < 0.1 else "uvw"[rng.integers(3)])
        for i in range(200)
    ]
    df = spark.createDataFrame(rows, "fold int, x double, s string")
    joint = fit_features(df, FeatureOptions(), ["fold"], [F.col("fold") != i for i in range(3)])
    for i, state in enumerate(joint):
        alone = fit_features(df.where(F.col("fold") != i), FeatureOptions(), ["fold"])[0]
        assert state["medians"] == alone["medians"] and state["modes"] == alone["modes"]
        assert features.category_lists(state) == features.category_lists(alone)
        assert math.isclose(state["stds"]["x"], alone["stds"]["x"], rel_tol=1e-12)


def test_fit_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(float(v), "ab"[int(v > 0)]) for v in rng.normal(size=300)], "x double, s string")
    one = fit_features(df.coalesce(1), FeatureOptions())[0]
    many = fit_features(df.repartition(7), FeatureOptions())[0]
    assert one["medians"] == many["medians"] and one["modes"] == many["modes"]
    assert math.isclose(one["means"]["x"], many["means"]["x"], rel_tol=1e-12, abs_tol=1e-12)


def test_roles_and_overrides(spark):
    df = spark.createDataFrame(
        [(1, 2.0, "a", True, "3")], "i int, d double, s string, b boolean, t string"
    )
    roles = column_roles(df.schema, ["i", "absent"], ["t"])
    assert roles.numeric == ["d", "t"] and roles.categorical == ["s", "i"] and roles.ignored == ["b"]
    state = fit_features(df, FeatureOptions(numerical_overrides=["t", "b"]))[0]
    assert state["medians"] == {"i": 1.0, "d": 2.0, "t": 3.0, "b": 1.0}


def test_leakage_names(spark):
    names = ["Bill_Amount", "age", "final_note", "preDISCHARGE"]
    assert leakage_columns(names, ["*discharge*", "*bill*", "*final*"]) == ["Bill_Amount", "final_note", "preDISCHARGE"]
    df = spark.createDataFrame([(1, 2)], "Bill int, age int")
    assert drop_leakage(df, ["*bill*"]).columns == ["age"]


def test_many_categories_keep_the_plan_narrow(spark):
    df = spark.createDataFrame([(i, f"v{i % 2500}") for i in range(5000)], "k int, s string")
    model = FeatureModel(fit_features(df, FeatureOptions(), ["k"])[0])
    assert len(model.feature_names) == 2500
    new = spark.createDataFrame([(0, "v7"), (1, "unseen"), (2, None)], "k int, s string")
    rows = {r["k"]: r["features"] for r in model.transform(new).collect()}
    mode = model.params_dict["modes"]["s"]
    assert model.feature_names[rows[0].indices[0]] == "s_v7" and rows[0].numNonzeros() == 1
    assert rows[1].numNonzeros() == 0
    assert model.feature_names[rows[2].indices[0]] == f"s_{mode}"
    plan = model.transform(new)._jdf.queryExecution().analyzed().toString()
    assert plan.count("\n") < 20


def test_long_one_hot(spark):
    df = spark.createDataFrame([(i, str(i % 4) if i % 5 else None) for i in range(40)], "k int, s string")
    known = features.category_table(df.where("s <> '3'"), ["s"])
    rows = features.one_hot_long(df, "k", ["s"], known).select("k", "column", "value").collect()
    assert sorted(map(tuple, rows)) == sorted((i, "s", str(i % 4)) for i in range(40) if i % 5 and i % 4 != 3)


def test_feature_model_is_saved(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b")], "x double, s string")
    model = PipelineModel([FeatureBuilder(options=FeatureOptions(missing_count=True)).fit(df)])
    model.write().overwrite().save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m"))
    assert isinstance(back.stages[0], FeatureModel)
    assert back.stages[0].feature_names == ["missing_count", "x", "s_a", "s_b"]
    assert back.transform(df).collect() == model.transform(df).collect()


def test_labels(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",)], "name string")
    index, encoded = labels.fit_transform(df, "name")
    assert index.classes == ["a", "b", "c"] and index.n_classes == 3
    assert sorted((r["name"], r["label_idx"]) for r in encoded.collect()) == [("a", 0), ("b", 1), ("b", 1), ("c", 2)]
    unknown = spark.createDataFrame([("z",)], "name string")
    with pytest.raises(Exception, match="unknown label: z"):
        index.transform(unknown, "name").collect()
    with pytest.raises(ValueError, match="missing values"):
        labels.LabelIndex.fit(spark.createDataFrame([(None,), ("a",)], "name string"), "name")
    assert labels.task_type(df, "name") == "multiclass"
    assert labels.task_type(df.where("name <> 'c'"), "name") == "binary"


def test_weights_sum_to_rows(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0), int(i % 7 == 0)) for i in range(100)], "k int, a int, b int")
    for scheme in ("inverse_freq", "balanced", "none"):
        total = weights.with_class_weight(df, "a", scheme).agg(F.sum("weight")).first()[0]
        assert math.isclose(total, 100.0)
    multi = weights.with_multilabel_weight(df, ["a", "b"])
    assert math.isclose(multi.agg(F.sum("weight")).first()[0], 100.0)
    with pytest.raises(ValueError, match="no class weights"):
        weights.with_class_weight(df, "a", "other")
    none = spark.createDataFrame([(0, 0), (0, 0)], "a int, b int")
    assert [r["weight"] for r in weights.with_multilabel_weight(none, ["a", "b"]).collect()] == [1.0, 1.0]
    assert weights.positive_ratio(none, "a").first()[0] == 1.0


def wide_rows(spark, n=700):
    data = [(i, f"v{i:05d}", "abc"[i % 3] if i % 4 else None, float(i % 10)) for i in range(n)]
    return spark.createDataFrame(data, "k int, s string, t string, x double").repartition(4)


def test_dictionary_over_many_ranges(spark, monkeypatch):
    """A column with as many values as rows, dealt over ranges: the same places as in one range."""
    df = wide_rows(spark)
    masks = [F.col("k") % 3 != i for i in range(3)]
    one = fit_features(df, FeatureOptions(), ["k"], masks)
    monkeypatch.setattr(dictionary, "RANGE_ROWS", 50)
    many = fit_features(df, FeatureOptions(), ["k"], masks)
    for a, b, i in zip(one, many, range(3)):
        assert (a["modes"], a["sizes"], a["bytes"]) == (b["modes"], b["sizes"], b["bytes"])
        assert features.category_lists(a) == features.category_lists(b)
        assert features.category_lists(a)["s"] == [f"v{k:05d}" for k in range(700) if k % 3 != i]


def test_wide_vectors_equal_narrow_ones(spark, monkeypatch):
    df = wide_rows(spark)
    model = FeatureModel(fit_features(df.where("k % 3 <> 0"), FeatureOptions(interaction_pairs=[["x", "x"]]), ["k"])[0])
    narrow = {r["k"]: r["features"] for r in model.transform(df).collect()}
    monkeypatch.setattr(features, "WIDE", 5)
    out = model.transform(df)
    assert out.columns == [*df.columns, "features"]
    wide = {r["k"]: r["features"] for r in out.collect()}
    assert all(wide[k].toArray().tolist() == narrow[k].toArray().tolist() for k in narrow) and len(wide) == 700
    names = [r["feature"] for r in model.names().orderBy("position").collect()]
    assert names == model.feature_names and len(names) == model.n_features == narrow[0].size


def test_names_of_too_many_categories_are_refused(spark, monkeypatch):
    state = fit_features(wide_rows(spark), FeatureOptions(), ["k"])[0]
    monkeypatch.setattr(features, "NAMED", 100)
    with pytest.raises(ValueError, match="703 categories"):
        FeatureModel(state).feature_names
    assert FeatureModel(state).names().count() == 704


def test_saved_dictionary_moves_with_the_model(spark, tmp_path):
    df = wide_rows(spark, 50)
    model = FeatureModel(fit_features(df, FeatureOptions(), ["k"])[0])
    before = model.transform(df).orderBy("k").collect()
    model.write().save(str(tmp_path / "a"))
    (tmp_path / "a").rename(tmp_path / "b")
    assert FeatureModel.load(str(tmp_path / "b")).transform(df).orderBy("k").collect() == before


def test_sparse_attribution_equals_dense(spark):
    df = wide_rows(spark, 60).withColumn("y", (F.col("k") % 2).cast("int"))
    model = FeatureModel(fit_features(df, FeatureOptions(), ["k", "y"])[0])
    fitted = models.fit_classifier(df, model, {"model": {"name": "lr"}}, "y", {0: 30, 1: 30}, 2, False)
    dense = explain.linear_model_attribution(fitted, df, 1, "a")
    long = explain.to_long(dense, "k", "a", model.feature_names)
    thin = sparse.linear_sparse(fitted, df, "k")
    want = {r["feature"]: r["mean_abs_shap"] for r in explain.global_importance(long).collect()}
    got = {r["feature"]: r["mean_abs_shap"] for r in thin.global_importance().collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[f], want[f], abs_tol=1e-12) for f in want)
    for k in (1, 4, 100):
        top = {(r["k"], r["rank"]): r["abs_value"] for r in explain.top_features(long, "k", k).collect()}
        mine = {(r["k"], r["rank"]): r["abs_value"] for r in thin.top_features(k).collect()}
        assert mine.keys() == top.keys() and all(math.isclose(mine[i], top[i], abs_tol=1e-12) for i in top)
    plans = [sparse.entries(model, d, "k")._jdf.queryExecution().analyzed().toString().count("\n") for d in (df, df.limit(0))]
    assert max(plans) < 40
