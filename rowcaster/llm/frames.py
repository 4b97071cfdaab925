"""Helpers of the operators on Spark frames."""

from __future__ import annotations

import pickle
from collections.abc import Sequence
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ARROW_BYTES = 2 << 20
BROADCAST_ROWS = 100_000
SALTS = 64


class Sent:
    """A bounded value broadcast to all tasks by value, so that executors need no copy of this package."""

    def __init__(self, spark: SparkSession, value):
        self.bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get(self):
        return pickle.loads(self.bytes.value)

    def release(self) -> None:
        self.bytes.unpersist()


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold about ``ARROW_BYTES``: rows of text differ too much for a bound on rows alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key, "67108864b") == "67108864b":  # not set by the user
        df.sparkSession.conf.set(key, str(ARROW_BYTES))
    return df


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.length(F.regexp_replace(text, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x"))
                      - F.when(text.rlike(r"^[\x20\x09-\x0D]"), F.length(F.regexp_extract(text, r"^[\x20\x09-\x0D]+", 0))).otherwise(0),
                      F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is. ``lower`` is the fast way where it agrees."""
    other = text.rlike(r"[[\p{IsUppercase}\p{Lt}]&&[^A-Z]]")
    return F.when(other, F.translate(text, UPPER, SMALL)).otherwise(F.lower(text))


def join_small(df: DataFrame, small: DataFrame, keys: Sequence[str], spread: str) -> DataFrame:
    """Left join with one row per key of ``small``, nulls matching nulls.

    Up to ``BROADCAST_ROWS`` rows (counted) are broadcast. A longer table is repeated under
    ``SALTS`` salts, so that the rows of a hot key, dealt by a hash of ``spread``, meet in
    many tasks; as Spark takes it for as long as its file, which the salts are not in, it is
    kept from broadcasting it. ``small`` should be cheap to read twice.
    """
    wide = small.count() > BROADCAST_ROWS
    renamed = small.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    if wide:
        renamed = renamed.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
        df = df.withColumn("_salt1", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    if wide:
        on.append(F.col("_salt1") == F.col("_salt2"))
    else:
        renamed = F.broadcast(renamed)
    out = df.join(renamed, reduce(lambda a, b: a & b, on), "left")
    return out.drop(*[f"_k{i}" for i in range(len(keys))], "_salt1", "_salt2")
