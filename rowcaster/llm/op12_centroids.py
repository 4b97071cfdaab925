"""Centroid clustering: k-means on whole numbers, with a vantage-point tree over the centroids.

Vectors of exactly ``size`` finite components become integers ``floor(scale * x)``, so that
every distance, sum and mean is exact and no order of rows, tasks or retries can change it.
Each round builds a vantage-point tree over the centroids on the driver and broadcasts it. A
vector searches it best first: it opens the subtree with the smallest bound, stops when that
bound is beyond its radius (the distance to the best centroid so far; a bound equal to it is
opened, so that ties are seen), and of centroids at the same distance the smaller number wins.
The searches of a batch run side by side, each with its own queue. Bounds are floating and
loosened by more than their error; distances are integers.

Tasks send one row of sums per centroid and component, whatever the number of vectors, so no
cluster is a hot key. The driver holds ``k`` centroids.

Defined results: a vector that is null, has another number of components or a null, NaN or
infinite one is left out. A component beyond 2^27 in magnitude after scaling takes its vector
out of the clustering, as a long could not hold squared distances: its row has a null cluster
and distance. A null id is hashed as an empty string. Rows with equal ids start in the order
of their vectors; repeated rows count as often as they are there. With fewer vectors than
``k`` there are as many centroids as vectors; an empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .frames import Sent

WIDEST = 1 << 27  # then squared distances over 64 components are below 2^63
CELLS = 1 << 20  # entries of the table of bounds (vectors by nodes) that a search holds


@dataclass(frozen=True)
class ClusterOptions:
    k: int = 8
    rounds: int = 10
    size: int = 64
    scale: int = 1024
    salt: str = "3:"  # before the id that is hashed for the start


@dataclass
class Node:
    """A centroid and two halves of others, each with its nearest and farthest squared distance to it."""

    centroid: int
    halves: tuple[int, ...] = ()
    spans: tuple[tuple[int, int], ...] = ()
    bucket: list[int] = field(default_factory=list)  # of a leaf, whose centroid is -1


class VantageTree:
    """Nearest of a set of integer points. Plain data, fit for a broadcast."""

    def __init__(self, points: np.ndarray, leaf: int = 2):
        self.points = np.asarray(points, np.int64)
        self.leaf = leaf
        self.nodes: list[Node] = []
        if len(self.points):
            self._grow(list(range(len(self.points))))

    def _grow(self, ids: list[int]) -> int:
        at = len(self.nodes)
        if len(ids) <= self.leaf:
            self.nodes.append(Node(-1, bucket=ids))
            return at
        vantage, rest = ids[0], np.array(ids[1:])
        self.nodes.append(Node(vantage))
        far = squared(self.points[rest], self.points[vantage])
        order = np.lexsort((rest, far))
        halves = [h for h in np.array_split(order, 2) if len(h)]
        node = self.nodes[at]
        node.spans = tuple((int(far[h].min()), int(far[h].max())) for h in halves)
        node.halves = tuple(self._grow([int(i) for i in rest[h]]) for h in halves)
        return at

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of and squared distance to the nearest point of each row."""
        who, best = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        step = max(1, CELLS // len(self.nodes))
        for a in range(0, len(x), step):
            who[a : a + step], best[a : a + step] = self._search(x[a : a + step])
        return who, best

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(x)
        who, best = np.full(n, len(self.points)), np.full(n, np.iinfo(np.int64).max)
        queue = np.full((n, len(self.nodes)), np.inf)  # bound of every node still to be opened
        queue[:, 0] = 0.0
        going = np.arange(n)
        while len(going):
            first = np.argmin(queue[going], axis=1)
            opened = queue[going, first] <= np.sqrt(best[going].astype(float)) * (1 + 1e-12)
            going, first = going[opened], first[opened]
            for i in np.unique(first):
                rows, node = going[first == i], self.nodes[i]
                bound = queue[rows, i]
                queue[rows, i] = np.inf
                for c in node.bucket if node.centroid < 0 else [node.centroid]:
                    far = squared(x[rows], self.points[c])
                    nearer = (far < best[rows]) | ((far == best[rows]) & (c < who[rows]))
                    best[rows[nearer]], who[rows[nearer]] = far[nearer], c
                if node.centroid >= 0:
                    here = np.sqrt(far.astype(float))
                    for child, span in zip(node.halves, node.spans):
                        low, high = np.sqrt(np.array(span, float))
                        slack = 1e-9 * (here + high) + 1e-9
                        queue[rows, child] = np.maximum(bound, np.maximum(here - high, low - here) - slack)
            going = going[np.isfinite(queue[going].min(axis=1))]
        return who, best


def squared(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    off = x - point
    return np.einsum("ij,ij->i", off, off)


def finite(vector: Column, size: int) -> Column:
    broken = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(vector) == size) & ~broken, F.lit(False))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def centroid_sums(vectors: DataFrame, tree: Sent, k: int, size: int) -> dict[int, list[int]]:
    """For each centroid that has vectors: their number, then their sum by component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, sums = tree.get(), np.zeros((k, size + 1), np.int64)
        for batch in batches:
            x = matrix(batch.column("x"), size)
            who, _ = points.nearest(x)
            for c in np.unique(who):
                sums[c, 0] += int((who == c).sum())
                sums[c, 1:] += x[who == c].sum(axis=0)
        used = np.flatnonzero(sums[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], ["c", "sums"])

    parts = vectors.select("x").mapInArrow(run, "c long, sums array<long>").select("c", F.posexplode("sums").alias("at", "v"))
    totals: dict[int, list[int]] = {}
    for r in parts.groupBy("c", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        totals.setdefault(r["c"], [0] * (size + 1))[r["at"]] = int(r["v"])
    return totals


def assigned(vectors: DataFrame, tree: Sent, size: int) -> DataFrame:
    """(id, cluster, distance) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = tree.get()
        for batch in batches:
            who, far = points.nearest(matrix(batch.column("x"), size))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(who, pa.int32()), pa.array(far, pa.int64())], ["id", "cluster", "distance"])

    return vectors.select("id", "x").mapInArrow(run, f"id {vectors.schema['id'].dataType.simpleString()}, cluster int, distance long")


def starts(vectors: DataFrame, options: ClusterOptions) -> list[list[int]]:
    key = F.sha2(F.concat(F.lit(options.salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [list(r["x"]) for r in vectors.select(key.alias("key"), "x").orderBy("key", "x").limit(options.k).collect()]


def cluster(vectors: DataFrame, options: ClusterOptions = ClusterOptions(), id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per vector: id, cluster, distance, cluster_inertia, inertia, centroid (its components), centroid_sha256."""
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("v")).where(finite(F.col("v"), options.size))
    scaled = F.transform("v", lambda x: F.floor(x.cast("double") * options.scale))
    # a first look at the size alone: the floor of a larger number would not be exact
    narrow = ~F.exists("v", lambda x: F.abs(x.cast("double")) * options.scale > WIDEST)
    table = written(kept.select("id", F.when(narrow, F.transform(scaled, lambda x: x.cast("int"))).alias("x")), "cluster-vectors")
    inside = table.where(F.col("x").isNotNull())
    centroids = starts(inside, options)
    k, size = len(centroids), options.size
    if k == 0:
        result = table.select("id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
    else:
        for _ in range(options.rounds):
            tree = Sent(spark, VantageTree(np.array(centroids, np.int64)))
            for c, (n, *total) in centroid_sums(inside, tree, k, size).items():
                centroids[c] = [s // n for s in total]
            tree.release()
        tree = Sent(spark, VantageTree(np.array(centroids, np.int64)))
        wide = table.where(F.col("x").isNull()).select("id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance"))
        result = written(assigned(inside, tree, size).unionByName(wide), "cluster-result")
        tree.release()
    spent = result.where(F.col("cluster").isNotNull()).groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    by_cluster = {r["cluster"]: int(r["d"]) for r in spent}
    total = sum(by_cluster.values())
    lines = [(c, by_cluster.get(c, 0), total, x, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    about = spark.createDataFrame(lines, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    # k rows
    return result.join(F.broadcast(about), "cluster", "left").select(
        F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256"
    )
