"""Fold numbers that depend only on the row key and the seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import unit_hash
from ..session import written
from .select import group_sizes, rank_by_unit


def stratified_folds(
    df: DataFrame,
    label: str,
    key: str,
    k: int = 5,
    seed: int = 42,
    unit: Column | None = None,
    out: str = "fold",
    rows_per_bucket: int = 1_000_000,
) -> DataFrame:
    """Deal the rows of each class to k folds in hash order, one class after another.

    A class begins where the one before it ended, so the folds differ by at most one row in
    total and in each class. Rows without a label are a class of their own.
    """
    if k < 2:
        raise ValueError("at least two folds are needed")
    sizes = group_sizes(df, label)
    order = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)  # one row per class
    starts = sizes.select("_g", (F.coalesce(F.sum("_n").over(order), F.lit(0)) % k).alias("_start"), "_n")
    largest = sizes.agg(F.max("_n")).first()[0]
    if largest is not None and largest < k:
        raise ValueError(f"every class of {label} has fewer than {k} rows")
    unit = unit_hash(key, seed=seed) if unit is None else unit
    ranked = rank_by_unit(df, label, unit, key, "_rank", rows_per_bucket)
    dealt = ranked.join(starts, F.col(label).eqNullSafe(F.col("_g")))
    return dealt.withColumn(out, ((F.col("_rank") + F.col("_start")) % k).cast("int")).select(*df.columns, out)


def group_folds(df: DataFrame, group: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """All rows of a group share a fold."""
    return df.withColumn(out, F.pmod(F.xxhash64(group, F.lit(seed)), F.lit(k)).cast("int"))


HEAVY = 100  # a group is heavy above 1 / (HEAVY * k) of the rows, so there are at most HEAVY * k of them


def group_class_folds(df: DataFrame, label: str, group: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Folds that share no group and have the classes in about the same shares.

    Light groups are dealt by a hash. Heavy ones, a bounded number, are then placed one by one,
    the largest first, each in the fold that leaves the shares of all classes most even. So a
    fold's share of a class is off by at most the largest group's share of it, besides what the
    hash leaves uneven among groups of under 1 / (HEAVY * k) of the rows each. A null group is
    one group, a null label one class.
    """
    if k < 2:
        raise ValueError("at least two folds are needed")
    counts = written(df.groupBy(F.col(group).alias("_g"), F.col(label).alias("_c")).agg(F.count("*").alias("_n")), "group-classes")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    sizes = counts.groupBy("_g").agg(F.sum("_n").alias("_size"))
    hashed = F.pmod(F.xxhash64(F.col("_g"), F.lit(seed)), F.lit(k)).cast("int")
    heavy = written(sizes.where(F.col("_size") * HEAVY * k > total), "heavy-groups").withColumnRenamed("_g", "_h")
    joined = counts.join(F.broadcast(heavy), F.col("_g").eqNullSafe(F.col("_h")), "left")
    light = joined.where(F.col("_size").isNull()).groupBy(hashed.alias("_f"), "_c").agg(F.sum("_n").alias("_n")).collect()
    large = joined.where(F.col("_size").isNotNull()).select("_g", "_c", "_n").collect()  # at most HEAVY * k groups
    classes = {r["_c"]: r["_t"] for r in counts.groupBy("_c").agg(F.sum("_n").alias("_t")).collect()}
    held = [dict.fromkeys(classes, 0) for _ in range(k)]
    for r in light:
        held[r["_f"]][r["_c"]] += r["_n"]
    vectors: dict = {}
    for r in large:
        vectors.setdefault(r["_g"], {})[r["_c"]] = r["_n"]

    def unevenness(f: int, own: dict) -> tuple[float, int, int]:
        """How much further from even the shares get with a group in fold ``f``; then its rows, then its number."""
        gain = 0.0
        for c, n in own.items():
            share, step = held[f][c] / classes[c], n / classes[c]
            gain += (share + step - 1 / k) ** 2 - (share - 1 / k) ** 2
        return round(gain, 12), sum(held[f].values()), f

    placed = []
    for g, own in sorted(vectors.items(), key=lambda t: (-sum(t[1].values()), repr(t[0]))):
        best = min(range(k), key=lambda f: unevenness(f, own))
        for c, n in own.items():
            held[best][c] += n
        placed.append((g, best))
    kind = df.schema[group].dataType.simpleString()
    table = df.sparkSession.createDataFrame(placed, f"_h {kind}, _f int")
    found = df.join(F.broadcast(table), F.col(group).eqNullSafe(F.col("_h")), "left")
    rest = F.pmod(F.xxhash64(F.col(group), F.lit(seed)), F.lit(k)).cast("int")
    return found.withColumn(out, F.coalesce("_f", rest)).select(*df.columns, out)


def plain_folds(df: DataFrame, key: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Folds by hash alone, without regard to the class."""
    return df.withColumn(out, F.floor(unit_hash(key, seed=seed) * F.lit(k)).cast("int"))


def stratified_holdout(
    df: DataFrame, label: str, key: str, seed: int = 42, k: int = 5, unit: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(train, test): one of k folds is held out, a fifth by default."""
    folded = stratified_folds(df, label, key, k, seed, unit)
    return folded.where("fold <> 0").drop("fold"), folded.where("fold = 0").drop("fold")
