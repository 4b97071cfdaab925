"""CSV scans and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from ..operators.features import quoted

# Texts read as missing.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
TRUE_FALSE = ("True", "False", "TRUE", "FALSE", "true", "false")


def _texts(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    raw = (
        spark.read.option("header", True).option("inferSchema", False).option("quote", '"')
        .option("escape", '"').option("multiLine", multi_line).csv(path)
    )
    return raw.select(
        *[F.when(~quoted(c).isin(*NULL_TOKENS), quoted(c)).alias(c) for c in raw.columns]
    )


def _typed(c: Column, data_type) -> Column:
    if isinstance(data_type, StringType):
        return c
    return F.trim(c).try_cast(data_type)


def infer_schema(texts: DataFrame) -> StructType:
    """bool, long, double or string per column, from one aggregate.

    Whole numbers with gaps become double and flags with gaps stay text.
    """
    aggregates = []
    for i, name in enumerate(texts.columns):
        c = quoted(name)
        t = F.trim(c)
        whole = t.rlike(r"^[+-]?\d+$") & t.try_cast("long").isNotNull()
        aggregates += [
            F.count(c).alias(f"n{i}"),
            F.count_if(c.isNull()).alias(f"g{i}"),
            F.count_if(c.isin(*TRUE_FALSE)).alias(f"b{i}"),
            F.count_if(whole).alias(f"l{i}"),
            F.count_if(t.try_cast("double").isNotNull()).alias(f"d{i}"),
        ]
    row = texts.agg(*aggregates).first()
    fields = []
    for i, name in enumerate(texts.columns):
        n, gaps = row[f"n{i}"], row[f"g{i}"]
        if n == 0:
            kind = DoubleType()
        elif row[f"b{i}"] == n and gaps == 0:
            kind = BooleanType()
        elif row[f"l{i}"] == n and gaps == 0:
            kind = LongType()
        elif row[f"d{i}"] == n:
            kind = DoubleType()
        else:
            kind = StringType()
        fields.append(StructField(name, kind))
    return StructType(fields)


def read_csv(
    spark: SparkSession, path: str, schema: StructType | None = None, multi_line: bool = False
) -> DataFrame:
    """Header row, comma separated. Types are inferred only when no schema is given.

    With a schema, columns are taken by name, columns missing in the file are left out,
    and extra columns stay text. ``multi_line`` allows line breaks inside quotes, at the
    price of one task per file.
    """
    texts = _texts(spark, path, multi_line)
    schema = infer_schema(texts) if schema is None else schema
    known = {f.name: f.dataType for f in schema.fields}
    return texts.select(
        *[_typed(quoted(c), known[c]).alias(c) if c in known else quoted(c) for c in texts.columns]
    )


def reject_counts(texts: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_rejected): present texts that are not numbers."""
    bad = [
        F.count_if(quoted(c).isNotNull() & F.trim(quoted(c)).try_cast("double").isNull()).alias(f"r{i}")
        for i, c in enumerate(columns)
    ]
    lines = [
        F.struct(F.lit(c).alias("column"), F.col(f"r{i}").alias("n_rejected")) for i, c in enumerate(columns)
    ]
    return texts.agg(*bad).select(F.inline(F.array(*lines)))


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """One file per task by default; ``single_file`` is for reports of bounded size."""
    if single_file:
        df = df.coalesce(1)
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
