import math

import pytest

from rowcaster.operators import confusion as cm
from rowcaster.operators import metrics as mt
from rowcaster.operators.multilabel import multilabel_metrics
from rowcaster.sources.artifacts import confusion_dict, named_report, report_dict

CLASSES = ["Arthritis", "Asthma", "Diabetes", "Heart_Disease", "Hypertension"]
# A published 5 x 5 count table (rows true) and the scores that belong to it.
COUNTS = [
    [110, 19, 56, 31, 29],
    [27, 35, 32, 18, 32],
    [67, 34, 37, 30, 45],
    [34, 12, 25, 120, 21],
    [46, 20, 41, 31, 48],
]
SCORES = {
    "accuracy": 0.35,
    "macro_f1": 0.33462265043502654,
    "weighted_f1": 0.34366275488527065,
    "macro_precision": 0.33374654650720925,
    "macro_recall": 0.33796926391163445,
}
CLASS_F1 = [
    0.4158790170132325, 0.26515151515151514, 0.18316831683168316, 0.5429864253393665, 0.2659279778393352
]


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(i, j) for i, line in enumerate(COUNTS) for j, n in enumerate(line) for _ in range(n)]
    return spark.createDataFrame(rows, "y int, pred int").repartition(4)


def test_published_scores(golden):
    got = mt.multiclass_metrics(golden, "y", "pred", classes=CLASSES)
    for name, value in SCORES.items():
        assert math.isclose(got[name], value, rel_tol=1e-12), name
    for name, value in zip(CLASSES, CLASS_F1):
        assert math.isclose(got["per_class"][name]["f1"], value, rel_tol=1e-12)


def test_published_report(golden):
    counts = cm.confusion_counts(golden, "y", "pred")
    report = report_dict(named_report(cm.classification_report(cm.class_stats(counts)), CLASSES))
    assert set(report) == {*CLASSES, "accuracy", "macro avg", "weighted avg"}
    assert math.isclose(report["accuracy"], 0.35)
    assert report["Diabetes"]["support"] == 213.0
    assert math.isclose(report["weighted avg"]["precision"], 0.33978198481121197, rel_tol=1e-12)
    assert math.isclose(report["macro avg"]["recall"], 0.33796926391163445, rel_tol=1e-12)
    matrix = confusion_dict(counts, list(range(5)))
    assert matrix == {"matrix": COUNTS, "labels": [0, 1, 2, 3, 4]}
    wide = cm.confusion_matrix(counts, [0, 1, 2, 3, 4]).orderBy("y").collect()
    assert [list(r)[1:] for r in wide] == COUNTS


def test_zero_denominators(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a"), ("a", "a")], "y string, pred string")
    counts = cm.confusion_counts(df, "y", "pred")
    stats = {r["label"]: r for r in cm.class_stats(counts).collect()}
    assert (stats["b"]["precision"], stats["b"]["recall"], stats["b"]["f1"]) == (0.0, 0.0, 0.0)
    assert (stats["c"]["precision"], stats["c"]["recall"], stats["c"]["support"]) == (0.0, 0.0, 1)
    assert math.isclose(stats["a"]["precision"], 2 / 3)
    assert cm.label_union(counts) == ["a", "b", "c"]
    line = cm.summary(cm.class_stats(counts)).first()
    assert line["accuracy"] == 0.5 and math.isclose(line["macro_precision"], 2 / 9)


def test_class_without_rows_is_listed(spark):
    df = spark.createDataFrame([(0, 0), (2, 0)], "y int, pred int")
    out = mt.multiclass_metrics(df, "y", "pred", classes=["x", "never", "z"])
    assert out["per_class"]["never"] == {"f1": 0.0, "precision": 0.0, "recall": 0.0}


def test_binary_confusion_union_labels(spark):
    df = spark.createDataFrame([(0, 1), (0, 1)], "y int, pred int")
    counts = cm.confusion_counts(df, "y", "pred")
    assert confusion_dict(counts, cm.label_union(counts)) == {"matrix": [[0, 2], [0, 0]], "labels": [0, 1]}


def test_multilabel_rows_without_labels(spark):
    df = spark.createDataFrame([(0, 0, 0, 0), (1, 0, 1, 1), (1, 1, 0, 1)], "a int, b int, pa int, pb int")
    line = multilabel_metrics(df, ["a", "b"], ["pa", "pb"]).first()
    assert math.isclose(line["samples_f1"], (0 + 2 / 3 + 2 / 3) / 3)
    assert math.isclose(line["accuracy"], 1 / 3)
    assert math.isclose(line["micro_f1"], 4 / 6)
    assert math.isclose(line["macro_f1"], (2 / 3 + 2 / 3) / 2)


def test_selector(spark):
    df = spark.createDataFrame([(0, [0.8, 0.2]), (1, [0.4, 0.6]), (1, [0.7, 0.3])], "y int, p array<double>")
    assert mt.scorer("roc_auc")(df, "y", "p") == 1.0
    assert mt.scorer("pr_auc")(df, "y", "p") == 1.0
    assert math.isclose(mt.scorer("f1")(df, "y", "p"), 2 / 3)
    assert mt.scorer(lambda d, y, p: 7.0)(df, "y", "p") == 7.0
    with pytest.raises(ValueError, match="calibration cannot be judged"):
        mt.scorer("unknown")
