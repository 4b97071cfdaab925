"""The categories of text columns as a table: values, their places, and their numbers by row mask.

Values are counted once for all columns, dealt over ranges of (column, value), and ranked
within their range; the number of values in earlier ranges comes from a table of one row per
range and column. So no task sees more than a range, and the driver sees one row per column.
Places are those of the sorted values, and a mask has places of its own for the values it has.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import new_path, written

RANGE_ROWS = 1_000_000  # values ranked by one task


@dataclass
class ColumnFacts:
    """What a mask has of a column: number of values, their bytes, and the most frequent one (ties: the smallest)."""

    size: int
    bytes: int
    mode: str | None


def build_dictionary(entries: DataFrame, columns: Sequence[str], n_masks: int) -> tuple[str, list[dict[str, ColumnFacts]]]:
    """(path, facts by mask). ``entries``: (column, value, n0, n1..) with the rows of each distinct pair by mask.

    The table at ``path`` has (column, value, n0.., p0..): a place is null where the mask lacks the value.
    """
    spark = entries.sparkSession
    counted = written(entries, "categories")
    ranges = max(1, -(-counted.count() // RANGE_ROWS))
    if ranges > 1:
        dealt = counted.repartitionByRange(ranges, "column", "value").withColumn("_range", F.spark_partition_id())
        counted = written(dealt, "categories")
    else:
        counted = counted.withColumn("_range", F.lit(0))
    seen = [F.coalesce(F.col(f"n{i}") > 0, F.lit(False)).cast("long") for i in range(n_masks)]
    upto = Window.partitionBy("column", "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumns({f"_r{i}": F.sum(s).over(upto) for i, s in enumerate(seen)})
    if ranges > 1:
        sums = counted.groupBy("column", "_range").agg(*[F.sum(s).alias(f"_s{i}") for i, s in enumerate(seen)])
        earlier = Window.partitionBy("column").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        before = sums.select("column", "_range", *[F.coalesce(F.sum(f"_s{i}").over(earlier), F.lit(0)).alias(f"_b{i}") for i in range(n_masks)])
        ranked = ranked.join(before, ["column", "_range"])
    else:
        ranked = ranked.withColumns({f"_b{i}": F.lit(0) for i in range(n_masks)})
    places = [F.when(s > 0, F.col(f"_b{i}") + F.col(f"_r{i}") - 1).alias(f"p{i}") for i, s in enumerate(seen)]
    path = new_path(spark, "dictionary")
    ranked.select("column", "value", *[f"n{i}" for i in range(n_masks)], *places).write.parquet(path)
    stored = spark.read.parquet(path)
    facts = []
    for i in range(n_masks):
        has = F.col(f"p{i}").isNotNull()
        facts += [
            F.count_if(has).alias(f"c{i}"), F.coalesce(F.sum(F.when(has, F.octet_length("value"))), F.lit(0)).alias(f"b{i}"),
            F.min(F.when(has, F.struct((-F.col(f"n{i}")).alias("n"), "value")))["value"].alias(f"m{i}"),
        ]
    rows = {r["column"]: r for r in stored.groupBy("column").agg(*facts).collect()} if columns else {}
    none = ColumnFacts(0, 0, None)
    return path, [{c: ColumnFacts(rows[c][f"c{i}"], rows[c][f"b{i}"], rows[c][f"m{i}"]) if c in rows else none for c in columns} for i in range(n_masks)]


def read_dictionary(spark: SparkSession, path: str, mask: int = 0) -> DataFrame:
    """(column, value, n, place) of the values that a mask has."""
    place = F.col(f"p{mask}")
    return spark.read.parquet(path).select("column", "value", F.col(f"n{mask}").alias("n"), place.alias("place")).where(place.isNotNull())


def copy_dictionary(dictionary: DataFrame, path: str) -> None:
    """Store one mask's part as a table of its own."""
    dictionary.withColumnsRenamed({"n": "n0", "place": "p0"}).write.parquet(path)


BROADCAST_BYTES = 32 << 20


def with_place(df: DataFrame, dictionary: DataFrame, column: str, value: Column, out: str, facts_bytes: int, size: int, more: Sequence[str] = ()) -> DataFrame:
    """Adds the place of ``value`` among the values of ``column`` (null: unknown), and ``more`` columns of the dictionary.

    A small part of the dictionary, by the bytes counted when it was made, is broadcast;
    otherwise adaptive execution splits the rows of a frequent value.
    """
    part = dictionary.where(F.col("column") == column).select(F.col("value").alias(f"{out}_k"), F.col("place").alias(out), *[F.col(c).alias(f"{out}_{c}") for c in more])
    if facts_bytes + 16 * size <= BROADCAST_BYTES:
        part = F.broadcast(part)
    named = df.withColumn(f"{out}_v", value)
    return named.join(part, F.col(f"{out}_v") == F.col(f"{out}_k"), "left").drop(f"{out}_v", f"{out}_k")
