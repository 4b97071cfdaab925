"""The table of scores against the metrics that read the rows, and against plain loops."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowcaster.operators import rankmetrics as rm
from rowcaster.operators import scores

from .test_rankmetrics import brute_ap, brute_auc, brute_threshold, sample


@pytest.mark.parametrize("buckets", [1, 3, 50])
@pytest.mark.parametrize("digits", [0, 1, 8])
def test_all_metrics_of_one_table(spark, buckets, digits):
    y, s = sample(digits + 20, digits=digits)
    df = spark.createDataFrame([(i % 4, a, b) for i, (a, b) in enumerate(zip(y, s))], "fold int, y int, s double").repartition(3)
    table = scores.score_table(rm.binary_scores(df, "y", "s"), buckets)
    by_fold = scores.score_table(df.select("fold", F.lit(0).alias("cls"), F.col("s").alias("score"), F.col("y").cast("long").alias("pos")), buckets)
    for t in (table, by_fold):
        assert math.isclose(t.areas().first()["auc"], brute_auc(y, s), abs_tol=1e-12)
        assert math.isclose(t.precisions().first()["ap"], brute_ap(y, s), abs_tol=1e-12)
        levels = [0.0, 0.01, 0.3, 0.5, 0.999, 1.0]
        assert np.allclose(t.quantiles(levels), np.quantile(s, levels))
        threshold, best = brute_threshold(y, s)
        got = t.best_threshold()
        assert math.isclose(got[1], best, abs_tol=1e-12) and math.isclose(got[0], threshold, abs_tol=1e-9)
    merged = {r["s"]: (r["n"], r["p"]) for r in by_fold.merged(F.col("fold") != 2).collect()}
    want: dict = {}
    for i, (a, b) in enumerate(zip(y, s)):
        if i % 4 != 2:
            n, p = want.get(b, (0, 0))
            want[b] = (n + 1, p + a)
    assert merged == want


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, 0.5), (1, None), (0, None), (0, 0.25)], "y int, s double")
    assert scores.binary_table(df, "y", "s").areas().first()["auc"] == 0.625  # a gap ranks lowest
    ones = scores.binary_table(df.where("y = 1"), "y", "s")
    assert ones.areas().first()["auc"] is None and ones.precisions().first()["ap"] == 1.0
    empty = scores.binary_table(df.limit(0), "y", "s")
    assert empty.areas().collect() == [] and empty.best_threshold() == (0.5, -1.0)
    assert scores.mean_of(empty.areas(), "auc") is None


def test_rows_are_shuffled_once(spark):
    df = spark.range(1000).select(F.lit(0).alias("cls"), F.rand(1).alias("score"), (F.col("id") % 3 == 0).cast("long").alias("pos"))
    table = scores.score_table(df)
    for result in (table.areas(), table.precisions()):
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 2 and "Window" not in plan  # sums by class alone
