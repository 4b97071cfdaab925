"""Whole jobs: train, score, explain and search on generated CSV files."""

import pytest
from pyspark.sql import functions as F

from rowcaster.plans.config import make_config
from rowcaster.plans.explain import explain_csv
from rowcaster.plans.predict import load_artifacts, predict_binary, predict_multiclass, predict_multilabel
from rowcaster.plans.train import train_binary, train_csv, train_multiclass
from rowcaster.plans.tune import tune
from rowcaster.sources import generated
from rowcaster.sources.artifacts import load_json
from rowcaster.sources.csv import read_csv, write_csv
from rowcaster.sources.publish import damaged, latest, publishing, versions

FAST = {
    "cv.folds": 2,
    "explain.sample": 20,
    "explain.classes": [0],
    "model.xgboost": {"n_estimators": 3, "max_depth": 2},
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("jobs")


def csv_of(spark, folder, name, make, n, drop=()):
    path = str(folder / name)
    write_csv(make(generated.range_keys(spark, n)).drop("row_id", *drop), path)
    return path


def test_binary_job(spark, folder):
    train = csv_of(spark, folder, "binary.csv", generated.binary_rows, 200)
    score = csv_of(spark, folder, "binary_new.csv", generated.binary_rows, 50, ["outcome"])
    out = str(folder / "binary")
    config = make_config({**FAST, "target.name": "outcome", "model.name": "logreg", "calibration.apply": True, "calibration.cv": 3})
    meta = train_csv(spark, train, config, out)
    assert len(load_artifacts(spark, out)[0].models) == 3
    assert meta["target"] == "outcome" and meta["task"] == "binary" and 0.0 <= meta["threshold"] <= 1.0
    assert not any("bill" in f or "discharge" in f for f in meta["features"])
    assert "bill_amount" not in meta["schema_columns"] and meta["calibration"]["selected"] in ("sigmoid", "isotonic")
    at = latest(spark, out)
    report = load_json(spark, f"{at}/cv_report")
    assert report["roc_auc"] > 0.6 and report["best_f1"] >= 0
    matrix = load_json(spark, f"{at}/confusion_matrix")
    assert sum(map(sum, matrix["matrix"])) == 200 and matrix["labels"] == [0, 1]
    predict_binary(spark, score, out, str(folder / "pred"), bands=True)
    back = read_csv(spark, str(folder / "pred"))
    assert back.columns == ["row_id", "prediction", "risk_level", "probability"] and back.count() == 50
    assert sorted(r["row_id"] for r in back.collect()) == list(range(50))
    cut = back.where((F.col("probability") >= meta["threshold"]) != (F.col("prediction") == 1))
    assert cut.count() == 0
    names = set(read_csv(spark, f"{at}/feature_importance").columns)
    assert names == {"feature", "importance"}
    assert read_csv(spark, f"{at}/attributions").count() == 20


def test_multiclass_job(spark, folder):
    train = csv_of(spark, folder, "multi.csv", generated.multiclass_rows, 400)
    score = csv_of(spark, folder, "multi_new.csv", generated.multiclass_rows, 60)
    out = str(folder / "multi")
    config = make_config({**FAST, "model.name": "logreg"})
    meta = train_multiclass(spark, read_csv(spark, train), config, out)
    assert meta["n_classes"] == len(meta["classes"]) >= 5 and meta["cv_accuracy"] > 0.3
    at = latest(spark, out)
    report = load_json(spark, f"{at}/classification_report")
    assert report["macro avg"]["support"] == 400.0
    matrix = read_csv(spark, f"{at}/confusion_matrix")
    assert matrix.columns == ["y", *meta["classes"]]
    top, share = predict_multiclass(spark, score, out, str(folder / "top"), str(folder / "proba"), top_k=3)
    assert top.columns[:4] == ["row_id", "prediction", "top1_disease", "top1_probability"] and top.count() == 60
    assert top.where("prediction <> top1_disease or top1_probability < top2_probability").count() == 0
    assert sum(r["n_rows"] for r in share.collect()) == 60
    assert read_csv(spark, str(folder / "proba")).columns == ["row_id", *meta["classes"]]
    keyed, _ = predict_multiclass(
        spark, score, out, str(folder / "top2"), str(folder / "proba2"), top_k=1, keep=["age", "gender"]
    )
    assert keyed.columns == ["age", "gender", "prediction", "top1_disease", "top1_probability"]
    explain_csv(spark, score, out, str(folder / "why"), sample_size=15, class_index=2)
    why = read_csv(spark, str(folder / "why") + "/attributions")
    assert why.columns == ["index", *meta["features"]] and why.count() == 15


def test_boosted_multiclass_job(spark, folder):
    data = generated.tiered_rows(generated.range_keys(spark, 200))
    out = str(folder / "tiers")
    meta = train_multiclass(spark, data, make_config({**FAST, "key": "row_id"}), out)
    model, back, index = load_artifacts(spark, out)
    assert back["classes"] == index.classes == meta["classes"]
    assert set(read_csv(spark, f"{latest(spark, out)}/attribution_importance/class=0").columns) == {"feature", "mean_abs_shap"}


def test_multilabel_job(spark, folder):
    rows = generated.multiclass_rows(generated.range_keys(spark, 200)).drop("prognosis")
    rows = rows.withColumn("high", (F.col("cholesterol") > 200).cast("int")).withColumn("old", (F.col("age") > 60).cast("int"))
    path = str(folder / "labels.csv")
    write_csv(rows.drop("row_id"), path)
    config = make_config(
        {**FAST, "target.multilabel": True, "target.multilabel_columns": ["high", "old"], "model.name": "logreg"}
    )
    meta = train_csv(spark, path, config, str(folder / "labels"))
    assert meta["task"] == "multilabel"
    report = load_json(spark, latest(spark, str(folder / "labels")) + "/cv_report")
    assert report["roc_auc_macro"] > 0.9 and set(report["per_class_auc"]) == {"high", "old"}
    predict_multilabel(spark, path, str(folder / "labels"), str(folder / "both"), {"old": 0.9}, keep=["age"])
    back = read_csv(spark, str(folder / "both"))
    assert back.columns == ["age", "pred_high", "pred_old", "score_high", "score_old"] and back.count() == 200
    assert back.where((F.col("score_old") >= 0.9) != (F.col("pred_old") == 1)).count() == 0
    assert back.where((F.col("score_high") >= 0.5) != (F.col("pred_high") == 1)).count() == 0
    explain_csv(spark, path, str(folder / "labels"), str(folder / "why_labels"), sample_size=10)
    for c in ("high", "old"):
        why = read_csv(spark, str(folder / "why_labels") + f"/attributions/label={c}")
        assert why.columns == ["index", *meta["features"]] and why.count() == 10


def test_rows_without_a_key_join_back(spark, folder):
    """Numbers of scored rows are those of the lines, whatever the splits of the file."""
    train = csv_of(spark, folder, "lines.csv", generated.multiclass_rows, 300)
    out = str(folder / "lines")
    train_multiclass(spark, read_csv(spark, train), make_config({**FAST, "model.name": "logreg"}), out)
    lines = [line for part in sorted((folder / "lines.csv").glob("part-*.csv")) for line in part.read_text().splitlines()[1:]]
    ages = {i: line.split(",")[0] for i, line in enumerate(lines)}
    runs = []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (before, "700"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            top, _ = predict_multiclass(spark, train, out, str(folder / f"o{size}"), str(folder / f"p{size}"), keep=["row_id", "age"])
            runs.append(sorted(map(tuple, top.collect())))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert runs[0] == runs[1] and [r[0] for r in runs[0]] == list(range(300))
    assert all(str(r[1]) == ages[r[0]] for r in runs[0])
    proba = read_csv(spark, str(folder / "p700"))
    assert proba.join(read_csv(spark, str(folder / "o700")), "row_id").count() == 300


@pytest.mark.parametrize("task", ["binary", "multiclass", "multilabel"])
def test_contract_of_every_task(spark, folder, task):
    """Every training job stores the contract, and rows that break it stop a scoring job before its sink."""
    rows = generated.multiclass_rows(generated.range_keys(spark, 120)).withColumn("high", (F.col("cholesterol") > 200).cast("int"))
    rows = rows.withColumn("old", (F.col("age") > 60).cast("int"))
    targets = {"binary": ["high"], "multiclass": ["prognosis"], "multilabel": ["high", "old"]}[task]
    rows = rows.drop(*({"high", "old", "prognosis"} - set(targets)))
    config = {**FAST, "model.name": "logreg", "key": "row_id", "target.name": targets[0]}
    config |= {"target.multilabel": True, "target.multilabel_columns": targets} if task == "multilabel" else {}
    path, out = str(folder / f"{task}-in.csv"), str(folder / f"{task}-out")
    write_csv(rows, path)
    meta = train_csv(spark, path, make_config(config), out)
    assert meta["task"] == task and "age" in meta["contract"]
    write_csv(rows.withColumn("age", F.when(F.col("row_id") == 7, F.lit(130)).otherwise(F.col("age"))), str(folder / f"{task}-old.csv"))
    sinks = [str(folder / f"{task}-{n}") for n in ("a", "b")]
    job = {"binary": predict_binary, "multiclass": predict_multiclass, "multilabel": predict_multilabel}[task]
    sinks = sinks if task == "multiclass" else sinks[:1]
    with pytest.raises(ValueError, match=r"age: between 0 and 120 \(1 rows\)"):
        job(spark, str(folder / f"{task}-old.csv"), out, *sinks)
    assert not any((folder / f"{task}-{n}").exists() for n in ("a", "b"))
    job(spark, path, out, *sinks)
    assert read_csv(spark, sinks[0]).count() == 120


def test_versions(spark, tmp_path):
    """A job that stops halfway leaves the version before it; a changed part is found out."""
    out = str(tmp_path / "a")
    for value in (1, 2):
        with publishing(spark, out) as draft:
            spark.range(value).write.parquet(f"{draft}/part")
            write_csv(spark.range(3), f"{draft}/deep/er")
    assert versions(spark, out) == [1, 2] and spark.read.parquet(f"{latest(spark, out)}/part").count() == 2
    with pytest.raises(RuntimeError, match="stopped"):
        with publishing(spark, out) as draft:
            spark.range(9).write.parquet(f"{draft}/part")
            raise RuntimeError("stopped")
    assert versions(spark, out) == [1, 2] and not list((tmp_path / "a").glob(".draft*"))
    (tmp_path / "a" / "v=000003").mkdir()  # a folder without a manifest is no version
    assert spark.read.parquet(f"{latest(spark, out)}/part").count() == 2
    assert damaged(spark, latest(spark, out)) == []
    part = next((tmp_path / "a" / "v=000002" / "deep" / "er").glob("part-*.csv"))
    (part.parent / f".{part.name}.crc").unlink()  # the local file system's own
    part.write_bytes(part.read_bytes() + b"9\n")
    assert len(damaged(spark, latest(spark, out))) == 1
    (tmp_path / "a" / "v=000003").rmdir()
    for _ in range(3):
        with publishing(spark, out) as draft:
            spark.range(1).write.parquet(f"{draft}/part")
    assert versions(spark, out) == [3, 4, 5]


def test_contract_holds_at_scoring(spark, folder):
    rows = generated.binary_rows(generated.range_keys(spark, 120))
    path, out = str(folder / "keyed.csv"), str(folder / "keyed")
    write_csv(rows, path)
    train_csv(spark, path, make_config({**FAST, "target.name": "outcome", "model.name": "logreg", "key": "row_id"}), out)
    assert predict_binary(spark, path, out, str(folder / "by_key")).columns == ["row_id", "prediction", "probability"]
    write_csv(rows.withColumn("age", F.lit(130)), str(folder / "old.csv"))
    with pytest.raises(ValueError, match="between 0 and 120"):
        predict_binary(spark, str(folder / "old.csv"), out, str(folder / "never"))


def test_search_job(spark, folder):
    data = generated.binary_rows(generated.range_keys(spark, 120))
    config = make_config({**FAST, "target.name": "outcome", "model.name": "logreg", "key": "row_id", "tuning.n_trials": 2})
    best, trials = tune(spark, data, config, str(folder / "search"))
    assert load_json(spark, str(folder / "search") + "/best_params") == best
    assert read_csv(spark, str(folder / "search") + "/trials").count() == trials.count() == 2


def test_missing_pieces_are_named(spark, folder):
    data = generated.binary_rows(generated.range_keys(spark, 20))
    with pytest.raises(ValueError, match="no column prognosis to learn"):
        train_multiclass(spark, data, make_config({"key": "row_id"}), str(folder / "x"))
    with pytest.raises(FileNotFoundError, match="no Model"):
        load_artifacts(spark, str(folder / "nothing"))
    broken = data.withColumn("age", F.lit(130))
    with pytest.raises(ValueError, match="between 0 and 120"):
        train_binary(spark, broken, make_config({"target.name": "outcome", "key": "row_id"}), str(folder / "y"))
    few = csv_of(spark, folder, "few.csv", generated.binary_rows, 5, ["bmi"])
    with pytest.raises(ValueError, match="the table lacks bmi"):
        predict_binary(spark, few, str(folder / "binary"), str(folder / "z"))
