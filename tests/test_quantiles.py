import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowcaster.operators import quantiles
from rowcaster.operators.quantiles import exact_medians, linear_quantiles, order_values


def frame(spark, columns):
    names = list(columns)
    rows = [tuple(None if v is None else float(v) for v in r) for r in zip(*columns.values())]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))


def expected(values):
    present = [v for v in values if v is not None]
    return float(np.median(present)) if present else None


def test_medians_narrowed_in_many_passes(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "COLLECT_LIMIT", 60)
    monkeypatch.setattr(quantiles, "SAMPLE_ROWS", 2000)
    rng = np.random.default_rng(1)
    n = 4000
    columns = {
        "normal": rng.normal(size=n),
        "one_hot_value": np.where(rng.random(n) < 0.9, 7.0, rng.normal(size=n)),
        "two_values": np.repeat([0.0, 1.0], n // 2),
        "gap_in_the_middle": np.concatenate([rng.uniform(0, 1, n // 2), rng.uniform(100, 101, n // 2)]),
        "exponential": np.exp(rng.normal(size=n) * 20),
        "constant": np.full(n, 3.5),
        "integers": rng.integers(0, 20, n).astype(float),
        "infinities": np.where(rng.random(n) < 0.3, -np.inf, rng.normal(size=n)),
        "mostly_gaps": [None if i % 50 else float(i) for i in range(n)],
        "all_gaps": [None] * n,
    }
    df = frame(spark, columns).repartition(5)
    got = exact_medians(df, {c: F.col(c) for c in columns}, True, {"rows": F.lit(True)})
    assert got.counted["rows"] == n
    for c, values in columns.items():
        assert got.values[c] == expected(list(values)), c
    count, mean, var = got.moments["integers"]
    assert count == n and math.isclose(mean, np.mean(columns["integers"])) and math.isclose(var, np.var(columns["integers"]))


def test_medians_in_batches(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SEARCHES_PER_PASS", 2)
    df = frame(spark, {c: [1.0 * i, 2.0, 5.0 + i] for i, c in enumerate("abcde")})
    got = exact_medians(df, {c: F.col(c) for c in "abcde"}, True)
    assert got.values == {c: expected([1.0 * i, 2.0, 5.0 + i]) for i, c in enumerate("abcde")}
    assert [got.moments[c][0] for c in "abcde"] == [3] * 5
    assert math.isclose(got.moments["e"][1], 5.0) and math.isclose(got.moments["a"][1], 7 / 3)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.floats(-5, 5), st.integers(-2, 2)), min_size=1, max_size=40))
def test_median_property(spark, values):
    df = frame(spark, {"x": values})
    assert exact_medians(df, {"x": F.col("x")}).values["x"] == expected(values)


@pytest.mark.parametrize("splits", [[], [0.0], [-1.0, -0.5, 0.0, 0.25, 2.0]])
def test_order_values_do_not_depend_on_splits(spark, splits):
    rng = np.random.default_rng(2)
    values = np.round(rng.normal(size=500), 1)
    df = frame(spark, {"x": values})
    ordered = sorted(values)
    ranks = [0, 1, 99, 250, 251, 498, 499]
    assert order_values(df, "x", ranks, splits) == {r: ordered[r] for r in ranks}


def test_linear_quantiles(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.gamma(2.0, size=777), 2)
    levels = [0.0, 0.01, 0.333, 0.5, 0.99, 1.0]
    got = linear_quantiles(frame(spark, {"x": values}), "x", levels)
    assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(got, np.quantile(values, levels)))
    assert linear_quantiles(frame(spark, {"x": [None]}), "x", levels) == []


def test_bad_samples_cost_time_only(spark, monkeypatch):
    """Trial brackets that miss the ranks are rejected by the counts."""
    monkeypatch.setattr(quantiles, "COLLECT_LIMIT", 100)
    real, calls = quantiles._suggest, []

    def misleading(df, searches, seed):
        real(df, searches, seed)
        calls.append(len(searches))
        if len(calls) <= 2:
            for s in searches:
                s.trial = (s.trial[1] + 5.0, s.trial[1] + 6.0)

    monkeypatch.setattr(quantiles, "_suggest", misleading)
    monkeypatch.setattr(quantiles, "SAMPLE_ROWS", 500)
    x = np.random.default_rng(5).normal(size=3000)
    df = frame(spark, {"x": x, "g": np.arange(3000) % 3})
    parts = {str(i): F.when(F.col("g") != i, F.col("x")) for i in range(3)}
    parts |= {"tail": F.when(F.col("x") > 1.5, F.col("x")), "none": F.when(F.col("g") > 5, F.col("x"))}
    got = exact_medians(df, parts, True, {"rows": F.lit(True)})
    for i in range(3):
        assert got.values[str(i)] == expected([v for j, v in enumerate(x) if j % 3 != i])
    assert got.values["tail"] == expected([v for v in x if v > 1.5]) and got.values["none"] is None
    assert got.counted["rows"] == 3000 and got.moments["none"] == (0, None, None) and len(calls) > 2
