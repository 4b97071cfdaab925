"""Count-based metrics. One grouped count over the rows; everything else reads its K x K result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f1_of_counts(hits: float, false_hits: float, misses: float) -> float:
    """2 hits / (2 hits + false hits + misses); 0 without any."""
    whole = 2 * hits + false_hits + misses
    return 2 * hits / whole if whole else 0.0


def ratio(num: Column, den: Column) -> Column:
    """Quotient, 0 on a zero denominator."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2.0 * precision * recall, precision + recall)


def confusion_counts(df: DataFrame, y: str, pred: str) -> DataFrame:
    """(y, pred, n), only pairs that occur."""
    return df.groupBy(F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def confusion_matrix(counts: DataFrame, labels: Sequence) -> DataFrame:
    """Rows true, one column per predicted label, zeros filled in, for the given labels."""
    kind = counts.schema["y"].dataType.simpleString()
    rows = counts.sparkSession.createDataFrame([(v,) for v in labels], f"y {kind}")
    wide = counts.groupBy("y").agg(
        *[
            F.sum(F.when(F.col("pred") == F.lit(v), F.col("n")).otherwise(0)).alias(str(v))
            for v in labels
        ]
    )
    return rows.join(wide, "y", "left").na.fill(0).orderBy("y")


def label_union(counts: DataFrame) -> list:
    """Sorted labels that occur as truth or prediction."""
    rows = counts.select(F.explode(F.array("y", "pred")).alias("v")).distinct().collect()
    return sorted(r["v"] for r in rows)


def class_stats(counts: DataFrame) -> DataFrame:
    """Per label: tp, support, predicted, precision, recall, f1."""
    hit = F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(F.lit(0))
    none = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("y").alias("label"), hit.alias("tp"), F.col("n").alias("support"), none.alias("predicted")),
        F.struct(F.col("pred").alias("label"), none.alias("tp"), none.alias("support"), F.col("n").alias("predicted")),
    )
    stats = (
        counts.select(F.inline(sides))
        .groupBy("label")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    )
    precision = ratio(F.col("tp"), F.col("predicted"))
    recall = ratio(F.col("tp"), F.col("support"))
    return stats.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1", f1(F.col("precision"), F.col("recall"))
    )


def summary(stats: DataFrame) -> DataFrame:
    """One row: accuracy, unweighted and support-weighted means over the labels."""

    def weighted(c: str) -> Column:
        return ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))

    return stats.agg(
        ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        weighted("precision").alias("weighted_precision"),
        weighted("recall").alias("weighted_recall"),
        weighted("f1").alias("weighted_f1"),
        F.sum("support").alias("support"),
    )


def per_class(stats: DataFrame, classes: Sequence[str]) -> DataFrame:
    """(class, precision, recall, f1, support) for the whole class list, by class number."""
    rows = stats.sparkSession.createDataFrame(list(enumerate(classes)), "label int, class string")
    measured = stats.select(F.col("label").cast("int").alias("label"), "precision", "recall", "f1", "support")
    return rows.join(measured, "label", "left").na.fill(0).drop("label")


def classification_report(stats: DataFrame) -> DataFrame:
    """Class rows, then accuracy (its value stands in f1), macro avg and weighted avg."""
    classes = stats.select(F.col("label").cast("string").alias("label"), "precision", "recall", "f1", "support")
    nothing = F.lit(None).cast("double")
    lines = F.array(
        F.struct(
            F.lit("accuracy").alias("label"), nothing.alias("precision"), nothing.alias("recall"),
            F.col("accuracy").alias("f1"), F.col("support").alias("support"),
        ),
        *[
            F.struct(
                F.lit(f"{kind} avg").alias("label"), F.col(f"{kind}_precision").alias("precision"),
                F.col(f"{kind}_recall").alias("recall"), F.col(f"{kind}_f1").alias("f1"),
                F.col("support").alias("support"),
            )
            for kind in ("macro", "weighted")
        ],
    )
    return classes.unionByName(summary(stats).select(F.inline(lines)))
