"""Centroid clustering against brute force in plain integers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowcaster.llm import op12_centroids as op12

from .fixture import CLASH, collected

SCHEMA = "vec_id long, embedding array<float>, label int"


def cluster_brute(data, k=8, rounds=10, size=64, scale=1024):
    kept = []
    for i, v, *_ in data:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(float(np.float32(x)) * scale) for x in v]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in order[:k]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        who = [near(x)[1] for _, x in kept]
        for j in range(len(centroids)):
            mine = [x for (_, x), w in zip(kept, who) if w == j]
            if mine:
                centroids[j] = [sum(col) // len(mine) for col in zip(*mine)]
    found = [(i, *near(x)) for i, x in kept]
    by = [sum(d for _, d, w in found if w == j) for j in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, w, d, by[w], sum(by), sha[w]) for i, d, w in found), key=repr)


def result(df):
    return collected(df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))


def vectors(n, seed=5, centres=5):
    r = random.Random(seed)
    middle = [[r.uniform(-0.5, 0.5) for _ in range(64)] for _ in range(centres)]
    return [(i, [x + r.gauss(0, 0.1) for x in r.choice(middle)], 0) for i in range(n)]


def odd_rows():
    data = vectors(120)
    data += [data[3], data[3], (None, data[4][1], None), (None, data[5][1], 1), (900, data[6][1], 0), (900, data[7][1], 0)]
    data += [(901, None, 0), (902, [], 0), (903, [0.1] * 63, 0), (904, [0.1] * 65, 0), (905, [None] + [0.1] * 63, 0)]
    data += [(906, [float("nan")] + [0.0] * 63, 0), (907, [float("inf")] + [0.0] * 63, 0), (908, [0.0] * 64, 0), (909, [-0.0001] * 64, 0)]
    return data


def test_clusters(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(4)
    clash = df.withColumns({c: F.lit(c) for c in [*CLASH, "id", "x", "v", "c", "cluster", "distance", "inertia", "centroid"] if c != "label"})
    assert result(op12.cluster(clash)) == cluster_brute(odd_rows())


def test_ties_go_to_the_smaller_number(spark):
    data = [(i, [float(i % 5)] + [0.0] * 63, 0) for i in range(200)]  # many vectors alike, centroids alike
    df = spark.createDataFrame(data, SCHEMA)
    for rounds in (0, 1, 10):
        assert result(op12.cluster(df, op12.ClusterOptions(rounds=rounds))) == cluster_brute(data, rounds=rounds)


def test_few_and_no_vectors(spark):
    few = vectors(3)
    assert result(op12.cluster(spark.createDataFrame(few, SCHEMA))) == cluster_brute(few)
    none = op12.cluster(spark.createDataFrame([], SCHEMA))
    assert none.collect() == [] and none.columns[:3] == ["vec_id", "cluster", "distance"]
    assert op12.cluster(spark.createDataFrame([(1, None, 0)], SCHEMA)).collect() == []


def test_components_beyond_a_long(spark):
    data = vectors(20)
    df = spark.createDataFrame([*data, (77, [1e30] + [0.0] * 63, 0)], SCHEMA)
    got = result(op12.cluster(df))
    assert (77, None, None, None, None, None) in got
    assert [r for r in got if r[0] != 77] == cluster_brute(data)


@pytest.mark.parametrize("n,leaf", [(1, 2), (2, 1), (8, 2), (100, 1), (300, 4)])
def test_tree_equals_all_distances(n, leaf):
    r = np.random.default_rng(n)
    points = r.integers(-3, 4, (n, 3))  # a small grid, so that many distances are equal
    x = np.concatenate([r.integers(-5, 6, (500, 3)), points])
    who, far = op12.VantageTree(points, leaf).nearest(x)
    every = ((x[:, None, :] - points[None]) ** 2).sum(-1)
    assert (far == every.min(1)).all() and (who == every.argmin(1)).all()


def test_tree_leaves_subtrees_closed(monkeypatch):
    r = np.random.default_rng(2)
    middle = r.integers(-100_000, 100_000, (32, 4))
    points = (middle[:, None, :] + r.integers(-10, 11, (32, 8, 4))).reshape(-1, 4)
    x = points + r.integers(-5, 6, points.shape)
    opened = 0
    plain = op12.squared

    def counted(a, b):
        nonlocal opened
        opened += len(a)
        return plain(a, b)

    tree = op12.VantageTree(points)
    monkeypatch.setattr(op12, "squared", counted)
    who, far = tree.nearest(x)
    every = ((x[:, None, :] - points[None]) ** 2).sum(-1)
    assert (far == every.min(1)).all() and (who == every.argmin(1)).all()
    assert opened < 0.3 * every.size
