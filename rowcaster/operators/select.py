"""Column selection, sampling, lookup and numbering of rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType, StructType

from ..functions.hashing import unit_hash
from ..session import written

BROADCAST_SPLITS = 200_000  # rows of a path and some numbers each


def drop_target(df: DataFrame, target: str | None) -> DataFrame:
    return df.drop(target) if target and target in df.columns else df


def leakage_columns(columns: Sequence[str], patterns: Sequence[str]) -> list[str]:
    """Names containing any pattern, ignoring case; ``*`` in a pattern carries no meaning."""
    needles = [p.replace("*", "").lower() for p in patterns]
    return [c for c in columns if any(n in c.lower() for n in needles)]


def drop_leakage(df: DataFrame, patterns: Sequence[str]) -> DataFrame:
    return df.drop(*leakage_columns(df.columns, patterns))


@dataclass
class Roles:
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    ignored: list[str] = field(default_factory=list)  # neither kind: bool, time, nested


def column_roles(
    schema: StructType,
    categorical_overrides: Sequence[str] = (),
    numerical_overrides: Sequence[str] = (),
    exclude: Sequence[str] = (),
) -> Roles:
    """Split by type in source order. A column named in an override comes after the typed
    ones of its kind; one named in both is a number."""
    fields = [f for f in schema.fields if f.name not in exclude]
    typed = {
        f.name: "numeric" if isinstance(f.dataType, NumericType) else "categorical" if isinstance(f.dataType, StringType) else "ignored"
        for f in fields
    }
    wanted = {c: "categorical" for c in categorical_overrides if c in typed}
    wanted |= {c: "numeric" for c in numerical_overrides if c in typed}
    moved = [c for c in wanted if wanted[c] != typed[c]]
    order = [c for c in typed if c not in moved] + moved
    kinds = typed | wanted
    return Roles(**{kind: [c for c in order if kinds[c] == kind] for kind in ("numeric", "categorical", "ignored")})


def preview(df: DataFrame, n: int = 5, order: str = "row_id") -> DataFrame:
    return df.orderBy(order).limit(n)


def row_lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def sample_rows(
    df: DataFrame, n: int, key: str, seed: int = 42, unit: Column | None = None
) -> DataFrame:
    """The ``n`` rows with the smallest hash of ``key``; all rows if there are fewer.

    One counting pass over the hash finds a power of two that at least ``n`` rows fall
    below, so the final top-n sees about ``2 n`` rows however large the table is.
    """
    unit = unit_hash(key, seed=seed) if unit is None else unit
    level = F.least(F.lit(62), F.floor(-F.log2(F.greatest(unit, F.lit(2.0**-62))))).cast("int")
    counts = {r["lv"]: r["c"] for r in df.groupBy(level.alias("lv")).agg(F.count("*").alias("c")).collect()}
    total, cut = 0, 0
    for lv in sorted(counts, reverse=True):
        total += counts[lv]
        if total >= n:
            cut = lv
            break
    else:
        return df
    picked = df.withColumn("_u", unit).where(level >= cut)
    return picked.orderBy("_u", key).limit(n).drop("_u")


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Dense 0-based row number in the order of the scanned files, whose rows are written once.

    Rows of a scan carry the path of their file and where their split of it begins; the
    written table adds the place of a row within its own file. A split's rows lie together, so
    a row's number is that of the rows in earlier splits (by path, then by beginning) and its
    place among its own. Other split sizes, another number of tasks or a rerun give the same
    numbers. A frame that is no scan of files is numbered as it is written.
    """
    try:
        marked = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    except AnalysisException:
        marked = df.select("*", F.lit("").alias("_file"), F.lit(0).cast("long").alias("_block"))
    stored = written(marked, "rows").select("*", F.col("_metadata.file_path").alias("_part"), F.col("_metadata.row_index").alias("_at"))
    split = ["_file", "_block", "_part"]
    splits = written(stored.groupBy(*split).agg(F.min("_at").alias("_first"), F.count("*").alias("_n")), "splits")
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = splits.groupBy("_file").agg(F.sum("_n").alias("_n")).select("_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_a"))
    earlier = Window.partitionBy("_file").orderBy("_block", "_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    starts = splits.select(*split, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_b"))
    starts = starts.join(files, "_file").select(*split, (F.col("_a") + F.col("_b") - F.col("_first")).alias("_start"))
    few = splits.count() <= BROADCAST_SPLITS
    placed = stored.join(F.broadcast(starts) if few else starts, split)
    return placed.withColumn(name, F.col("_start") + F.col("_at")).select(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns], name)


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    """(group, rows): one row per group, null among them."""
    return df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))


def rank_by_unit(
    df: DataFrame,
    group: str,
    unit: Column,
    tiebreak: str,
    out: str,
    rows_per_bucket: int = 1_000_000,
) -> DataFrame:
    """0-based rank by a uniform value inside each group; null is a group like any other.

    A group may hold most of the table, so each is cut into as many equal ranges of the
    uniform value as its own rows call for; a range is ranked alone and shifted by the size
    of the ranges before it. There is one plan for all sizes, and the result does not depend
    on the ranges. A row without a uniform value (its key is null) comes first.
    """
    marked = df.withColumn("_u", F.coalesce(unit, F.lit(0.0)))
    ranges = group_sizes(marked, group).select("_g", F.ceil(F.col("_n") / F.lit(rows_per_bucket)).alias("_r"))
    within = F.least(F.floor(F.col("_u") * F.col("_r")), F.col("_r") - 1).cast("long")
    placed = marked.join(ranges, F.col(group).eqNullSafe(F.col("_g"))).withColumn("_b", within)
    sizes = placed.groupBy("_g", "_b").agg(F.count("*").alias("_c"))
    earlier = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("_g").alias("_og"), F.col("_b").alias("_ob"), F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before")
    )
    local = Window.partitionBy(group, "_b").orderBy("_u", tiebreak)
    ranked = placed.join(offsets, F.col("_g").eqNullSafe(F.col("_og")) & (F.col("_b") == F.col("_ob")))
    return ranked.withColumn(out, F.col("_before") + F.row_number().over(local) - 1).select(*df.columns, out)


def class_counts(df: DataFrame, label: str) -> dict:
    """Rows per class, for what lists the classes anyway: label files, weights, models."""
    return {r["_g"]: r["_n"] for r in group_sizes(df, label).collect()}
