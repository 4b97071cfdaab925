"""Label dictionary, task type, encoding and decoding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import decode
from .select import class_counts


@dataclass
class LabelIndex:
    """Sorted distinct names, numbered from 0."""

    classes: list

    @property
    def n_classes(self) -> int:
        return len(self.classes)

    @property
    def mapping(self) -> dict:
        return {name: i for i, name in enumerate(self.classes)}

    @staticmethod
    def fit(df: DataFrame, label: str) -> LabelIndex:
        names = list(class_counts(df, label))
        if None in names:
            raise ValueError(f"{label} has missing values")
        return LabelIndex(sorted(names))

    def table(self, df: DataFrame, label: str) -> DataFrame:
        """(name, idx), one row per class."""
        kind = df.schema[label].dataType.simpleString()
        rows = list(self.mapping.items())
        return df.sparkSession.createDataFrame(rows, f"`{label}` {kind}, idx int")

    def transform(self, df: DataFrame, label: str, out: str = "label_idx") -> DataFrame:
        """Adds the class number; a name outside the dictionary fails the job."""
        found = df.join(self.table(df, label), label, "left")
        unknown = F.raise_error(F.concat(F.lit("unknown label: "), F.col(label).cast("string")))
        index = F.when(F.col("idx").isNotNull(), F.col("idx")).otherwise(unknown.cast("int"))
        return found.withColumn(out, index).drop("idx").select(*df.columns, out)

    def inverse(self, df: DataFrame, index: str, out: str) -> DataFrame:
        return df.withColumn(out, decode(index, self.classes))


def fit_transform(df: DataFrame, label: str, out: str = "label_idx") -> tuple[LabelIndex, DataFrame]:
    index = LabelIndex.fit(df, label)
    return index, index.transform(df, label, out)


def task_type(df: DataFrame, target: str | None, multilabel: bool = False) -> str:
    """``multilabel`` if flagged, ``binary`` for two classes, else ``multiclass``."""
    if multilabel:
        return "multilabel"
    if target is None or target not in df.columns:
        return "multiclass"
    distinct = df.groupBy(target).count().where(F.col(target).isNotNull()).limit(3).count()
    return "binary" if distinct == 2 else "multiclass"
