"""Output tables of scoring. All of them are one projection over the probability array."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import argmax_index, decode, max_confidence, ranked, top_string
from ..functions.scalar import above, binary_caption, class_caption, percent, risk_band

DEFAULT_THRESHOLD = 0.5


def resolve_threshold(option: float | None, stored: float | None) -> float:
    """The option, else the stored value, else 0.5."""
    return next((t for t in (option, stored) if t is not None), DEFAULT_THRESHOLD)


def binary_output(
    df: DataFrame, proba: str, threshold: float, keep: Sequence[str] = (), bands: bool = False
) -> DataFrame:
    """prediction, [risk_level,] probability"""
    p = F.col(proba)[1]
    prediction = above(p, threshold)
    columns = [prediction.alias("prediction")]
    if bands:
        columns.append(risk_band(prediction, p).alias("risk_level"))
    return df.select(*keep, *columns, p.alias("probability"))


def multiclass_output(df: DataFrame, proba: str, n_classes: int, keep: Sequence[str] = ()) -> DataFrame:
    """prediction, class_0_proba, class_1_proba, ..."""
    return df.select(
        *keep,
        argmax_index(proba).alias("prediction"),
        *[F.col(proba)[i].alias(f"class_{i}_proba") for i in range(n_classes)],
    )


def probability_table(df: DataFrame, proba: str, classes: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One column per class name."""
    return df.select(*keep, *[F.col(proba)[i].alias(c) for i, c in enumerate(classes)])


def topk_output(
    df: DataFrame, proba: str, classes: Sequence[str], k: int = 3, keep: Sequence[str] = ()
) -> DataFrame:
    """prediction, top1_disease, top1_probability, ..."""
    k = min(k, len(classes))
    entries = df.select(*keep, ranked(proba, classes).alias("_r"))
    columns = [F.col("_r")[0]["name"].alias("prediction")]
    for i in range(k):
        columns.append(F.col("_r")[i]["name"].alias(f"top{i + 1}_disease"))
        columns.append(F.col("_r")[i]["p"].alias(f"top{i + 1}_probability"))
    return entries.select(*keep, *columns)


def ranked_text_output(
    df: DataFrame, proba: str, classes: Sequence[str], k: int = 3, keep: Sequence[str] = ()
) -> DataFrame:
    """predicted_disease, rank1_disease, rank1_probability as percent text, ..."""
    k = min(k, len(classes))
    entries = df.select(*keep, ranked(proba, classes).alias("_r"))
    columns = [F.col("_r")[0]["name"].alias("predicted_disease")]
    for i in range(k):
        columns.append(F.col("_r")[i]["name"].alias(f"rank{i + 1}_disease"))
        columns.append(percent(F.col("_r")[i]["p"]).alias(f"rank{i + 1}_probability"))
    return entries.select(*keep, *columns)


def record_output(df: DataFrame, proba: str, classes: Sequence[str], number: str) -> DataFrame:
    """Patient (1-based), Predicted_Disease, Confidence, Top_3_Diseases"""
    entries = df.select((F.col(number) + 1).alias("Patient"), ranked(proba, classes).alias("_r"))
    best = F.col("_r")[0]
    return entries.select(
        "Patient",
        best["name"].alias("Predicted_Disease"),
        percent(best["p"]).alias("Confidence"),
        top_string("_r", 3).alias("Top_3_Diseases"),
    )


def caption_output(df: DataFrame, proba: str, n_classes: int, keep: Sequence[str] = ()) -> DataFrame:
    """disease caption and the highest probability."""
    caption = binary_caption(F.col(proba)[1]) if n_classes == 2 else class_caption(argmax_index(proba))
    return df.select(*keep, caption.alias("disease"), max_confidence(proba).alias("confidence"))


def ranked_records(df: DataFrame, proba: str, classes: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(disease, probability, is_predicted) with position 1 for the most probable."""
    entries = df.select(*keep, F.posexplode(ranked(proba, classes)).alias("pos", "e"))
    return entries.select(
        *keep,
        (F.col("pos") + 1).alias("position"),
        F.col("e.name").alias("disease"),
        F.col("e.p").alias("probability"),
        (F.col("pos") == 0).alias("is_predicted"),
    )


def predicted_name(df: DataFrame, proba: str, classes: Sequence[str], out: str = "prediction") -> DataFrame:
    return df.withColumn(out, decode(argmax_index(proba), classes))


def value_share(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """(value, n_rows, share): most frequent first, name breaks ties, at most ``n`` lines."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n_rows"))
    total = counts.agg(F.sum("n_rows")).scalar()  # scalar subquery over the merged rows
    return (
        counts.withColumn("share", F.col("n_rows") / total).orderBy(F.desc("n_rows"), "value").limit(n)
    )


def positive_summary(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col(prediction) == 1).alias("positive"),
        F.count_if(F.col(prediction) == 0).alias("negative"),
    )
