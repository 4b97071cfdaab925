"""Reports, label lists and metadata beside a saved model."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.labels import LabelIndex


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def require_artifact(spark: SparkSession, path: str, what: str) -> None:
    if not exists(spark, path):
        raise FileNotFoundError(f"no {what} below {path}: train first, or name the folder of another run")


def save_json(spark: SparkSession, value: dict, path: str) -> None:
    """A small document as one text file below ``path``."""
    line = spark.createDataFrame([(json.dumps(value, sort_keys=False),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def save_labels(spark: SparkSession, index: LabelIndex, path: str) -> None:
    numbers = range(index.n_classes)
    save_json(spark, {"classes": index.classes, "mapping": dict(zip(map(str, index.classes), numbers))}, path)


def load_labels(spark: SparkSession, path: str) -> LabelIndex:
    """Names come back as text, in the order of their numbers."""
    numbered = sorted((int(i), name) for name, i in load_json(spark, path)["mapping"].items())
    return LabelIndex([name for _, name in numbered])


def report_dict(report: DataFrame) -> dict:
    """A classification report as nested values; accuracy is a single number."""
    out: dict = {}
    for r in report.collect():
        if r["label"] == "accuracy":
            out["accuracy"] = r["f1"]
        else:
            out[r["label"]] = {
                "precision": r["precision"],
                "recall": r["recall"],
                "f1-score": r["f1"],
                "support": float(r["support"]),
            }
    return out


def confusion_dict(counts: DataFrame, labels: list) -> dict:
    """{matrix, labels} over one label list for rows and columns."""
    at = {v: i for i, v in enumerate(labels)}
    matrix = [[0] * len(labels) for _ in labels]
    for r in counts.collect():
        matrix[at[r["y"]]][at[r["pred"]]] = r["n"]
    return {"matrix": matrix, "labels": labels}


def named_report(report: DataFrame, classes: list[str]) -> DataFrame:
    """Class numbers of a report replaced by names; summary lines keep theirs."""
    names = F.array(*[F.lit(c) for c in classes])
    number = F.col("label").try_cast("int")
    return report.withColumn(
        "label", F.when(number.isNotNull(), F.element_at(names, number + 1)).otherwise(F.col("label"))
    )
