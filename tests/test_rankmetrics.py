import itertools
import math

from fractions import Fraction

import numpy as np
import pytest

from rowcaster.operators import rankmetrics as rm


def brute_auc(y, s):
    pos, neg = [v for v, t in zip(s, y) if t == 1], [v for v, t in zip(s, y) if t != 1]
    if not pos or not neg:
        return None
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def brute_ap(y, s):
    total, out, before = sum(y), 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        called = [a for a, v in zip(y, s) if v >= t]
        recall = sum(called) / total
        out += (recall - before) * sum(called) / len(called)
        before = recall
    return out


def brute_threshold(y, p):
    """Every level in turn, with exact shares; the first of the best."""
    pairs, real = list(zip(y, p)), sum(y)

    def share(level):
        called = [a for a, v in pairs if v >= level]
        return Fraction(2 * sum(called), len(called) + real) if called or real else Fraction(0)

    levels = sorted(set(map(float, np.quantile(np.asarray(p), np.linspace(0.01, 0.99, 199)))))
    top = max(levels, key=lambda v: (share(v), -v))
    return top, float(share(top))


def sample(seed, n=300, digits=1):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(int).tolist()
    s = np.round(rng.normal(size=n) + np.array(y) * 0.5, digits).tolist()
    return y, s


@pytest.mark.parametrize("buckets", [1, 2, 7, 512])
@pytest.mark.parametrize("digits", [0, 1, 8])
def test_areas_against_brute_force(spark, buckets, digits):
    y, s = sample(digits, digits=digits)
    df = spark.createDataFrame(list(zip(y, s)), "y int, s double").repartition(3)
    assert math.isclose(rm.roc_auc(df, "y", "s", buckets).first()[0], brute_auc(y, s), abs_tol=1e-12)
    assert math.isclose(rm.average_precision(df, "y", "s", buckets).first()[0], brute_ap(y, s), abs_tol=1e-12)


def test_one_score_holds_most_rows(spark):
    y, s = sample(9, 600, 3)
    s = [0.25 if i % 3 else v for i, v in enumerate(s)]
    df = spark.createDataFrame(list(zip(y, s)), "y int, s double")
    assert math.isclose(rm.roc_auc(df, "y", "s", 16).first()[0], brute_auc(y, s), abs_tol=1e-12)
    assert math.isclose(rm.average_precision(df, "y", "s", 16).first()[0], brute_ap(y, s), abs_tol=1e-12)


def test_negated_score_mirrors_the_area(spark):
    y, s = sample(5)
    up = spark.createDataFrame(list(zip(y, s)), "y int, s double")
    down = spark.createDataFrame([(a, -b) for a, b in zip(y, s)], "y int, s double")
    total = rm.roc_auc(up, "y", "s").first()[0] + rm.roc_auc(down, "y", "s").first()[0]
    assert math.isclose(total, 1.0, abs_tol=1e-12)


def test_degenerate_truth_and_scores(spark):
    same = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.5)], "y int, s double")
    assert rm.roc_auc(same, "y", "s").first()[0] == 0.5
    single = spark.createDataFrame([(1, 0.1), (1, 0.2), (1, 0.3)], "y int, s double")
    assert rm.roc_auc(single, "y", "s").first()[0] is None
    nothing = spark.createDataFrame([(0, 0.1), (0, 0.2)], "y int, s double")
    assert rm.average_precision(nothing, "y", "s").first()[0] is None


def class_sample(seed, n=200, k=4):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, k, n).tolist()
    p = np.round(rng.dirichlet(np.ones(k), n), 2)
    return y, p.tolist()


def test_pairs_and_rest_against_brute_force(spark):
    k = 4
    y, p = class_sample(3, k=k)
    df = spark.createDataFrame(list(zip(y, p)), "y int, p array<double>")
    pairs = []
    for a, b in itertools.permutations(range(k), 2):
        rows = [(int(t == a), v[a]) for t, v in zip(y, p) if t in (a, b)]
        pairs.append(brute_auc(*zip(*rows)))
    assert math.isclose(rm.roc_auc_ovo(df, "y", "p", k, 5).first()[0], np.mean(pairs), abs_tol=1e-12)
    rest = [brute_auc([int(t == a) for t in y], [v[a] for v in p]) for a in range(k)]
    assert math.isclose(rm.roc_auc_ovr(df, "y", "p", k, 5).first()[0], np.mean(rest), abs_tol=1e-12)
    ap = [brute_ap([int(t == a) for t in y], [v[a] for v in p]) for a in range(k)]
    assert math.isclose(rm.average_precision_macro(df, "y", "p", k, 5).first()[0], np.mean(ap), abs_tol=1e-12)


def test_absent_class_gives_no_macro_area(spark):
    df = spark.createDataFrame([(0, [0.5, 0.3, 0.2]), (1, [0.2, 0.6, 0.2])], "y int, p array<double>")
    assert rm.roc_auc_ovr(df, "y", "p", 3).first()[0] is None
    assert rm.roc_auc_ovo(df, "y", "p", 3).first()[0] is None


@pytest.mark.parametrize("digits", [1, 6])
def test_threshold_against_brute_force(spark, digits):
    rng = np.random.default_rng(digits)
    y = (rng.random(400) < 0.3).astype(int)
    p = np.round(1 / (1 + np.exp(-(rng.normal(size=400) + y))), digits)
    df = spark.createDataFrame(list(zip(y.tolist(), p.tolist())), "y int, p double")
    got = rm.best_f1_threshold(df, "y", "p")
    want = brute_threshold(y, p)
    assert math.isclose(got[0], want[0], abs_tol=1e-12) and math.isclose(got[1], want[1], abs_tol=1e-12)


def test_threshold_defaults(spark):
    empty = spark.createDataFrame([], "y int, p double")
    assert rm.best_f1_threshold(empty, "y", "p") == (0.5, -1.0)


def test_plan_has_no_unbounded_single_partition(spark):
    """Only bucket totals may meet in one task: no window over the rows lacks a bucket key."""
    y, s = sample(1)
    df = spark.createDataFrame(list(zip(y, s)), "y int, s double")
    plan = rm.roc_auc(df, "y", "s")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
