"""Metrics over several 0/1 labels per row. One aggregate pass, no row shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .confusion import ratio


def _add(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def multilabel_metrics(df: DataFrame, truth: Sequence[str], pred: Sequence[str]) -> DataFrame:
    """One row: macro_f1, micro_f1, samples_f1, accuracy (all labels of a row right)."""
    pairs = list(zip(truth, pred))
    tp_row = _add([(F.col(t) * F.col(p)).cast("long") for t, p in pairs])
    size_row = _add([(F.col(t) + F.col(p)).cast("long") for t, p in pairs])
    exact = reduce(lambda a, b: a & b, [F.col(t) == F.col(p) for t, p in pairs])
    sums = df.agg(
        *[F.sum((F.col(t) * F.col(p)).cast("long")).alias(f"tp{i}") for i, (t, p) in enumerate(pairs)],
        *[F.sum((F.col(t) + F.col(p)).cast("long")).alias(f"sz{i}") for i, (t, p) in enumerate(pairs)],
        F.avg(ratio(2.0 * tp_row, size_row)).alias("samples_f1"),
        F.avg(exact.cast("double")).alias("accuracy"),
    )
    k = len(pairs)
    each = [ratio(2.0 * F.col(f"tp{i}"), F.col(f"sz{i}")) for i in range(k)]
    micro = ratio(
        2.0 * _add([F.col(f"tp{i}") for i in range(k)]), _add([F.col(f"sz{i}") for i in range(k)])
    )
    return sums.select(
        (_add(each) / k).alias("macro_f1"), micro.alias("micro_f1"), "samples_f1", "accuracy"
    )


def apply_threshold(proba: Column | str, threshold: float = 0.5) -> Column:
    """Element-wise decision over a probability array."""
    c = F.col(proba) if isinstance(proba, str) else proba
    return F.transform(c, lambda x: (x >= F.lit(threshold)).cast("int"))
