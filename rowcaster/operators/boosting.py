"""Boosting of all classes at once, with penalised leaves.

Every round takes the gradient and the curvature of the loss (softmax over the classes, or the
logistic loss of two) from the margins so far, fits one regression tree per class to their
quotient weighted by the curvature, and then sets the leaves itself: one grouped sum over all
classes gives the gradient G and curvature H of each leaf, whose value is

    -learning_rate * shrunk(G, reg_alpha) / (H + reg_lambda)

where ``shrunk`` moves G towards zero by ``reg_alpha``. Before that, splits are taken back: where a
side has less curvature than ``min_child_weight``, and, from the leaves up, where the gain under
the same penalties is less than ``gamma``. ``subsample`` picks rows by a hash of their key (of their
content, without a key) and the round, ``colsample_bytree`` the features of a tree by the seed.

The margins of all rows are a column, written every ``CUT`` rounds, so that neither plan nor
recovery grows with the rounds. The model is a table of nodes, bounded by its options.
"""

from __future__ import annotations

import random
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import StorageLevel, cloudpickle, inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import current, written

CUT = 10  # rounds between two written tables of margins
BINS = 256  # of a feature that a tree looks at
CHUNK = 1 << 22  # nodes (rows by trees) that scoring holds at once

# the scoring function is sent to the executors whole; they need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class BoostOptions:
    n_estimators: int = 100
    learning_rate: float = 0.3
    max_depth: int = 6
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    seed: int = 42

    @staticmethod
    def of(options: dict, seed: int) -> BoostOptions:
        """From a config section; other options are left to the reader of the config."""
        kinds = {"n_estimators": int, "max_depth": int}
        names = [n for n in BoostOptions.__dataclass_fields__ if n != "seed" and options.get(n) is not None]
        return BoostOptions(**{n: kinds.get(n, float)(options[n]) for n in names}, seed=seed)


# --- trees -------------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes in preorder; a leaf has left = -1. G, H and rows are those of the sampled rows."""

    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    gradient: np.ndarray
    curvature: np.ndarray
    rows: np.ndarray
    value: np.ndarray
    gain: np.ndarray


SPLIT = re.compile(r"\s*If \(feature (\d+) <= (\S+)\)")


def structure(text: str, features: list[int] | None) -> tuple[list[int], list[int], list[int], list[float]]:
    """(left, right, feature, cut) of the nodes of a printed tree, in preorder."""
    left, right, feature, cut, open_ = [], [], [], [], []
    for line in text.splitlines()[1:]:
        split = SPLIT.match(line)
        if split is None and "Predict:" not in line:
            continue
        at = len(left)
        if open_:  # the child that the nearest open node still lacks
            parent = open_[-1]
            if left[parent] < 0:
                left[parent] = at
            else:
                right[parent] = at
                open_.pop()
        left.append(-1)
        right.append(-1)
        feature.append(-1 if split is None else int(split[1]) if features is None else features[int(split[1])])
        cut.append(0.0 if split is None else float(split[2]))
        if split is not None:
            open_.append(at)
    return left, right, feature, cut


def shrunk(g, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def settled(text: str, features: list[int] | None, leaves: dict[int, tuple[float, float, int]], o: BoostOptions) -> tuple[Tree, np.ndarray]:
    """The tree with its own leaf values, and the value at each leaf of the tree as it was fitted.

    ``leaves``: G, H and rows by the number of the leaf from left to right; a leaf without
    sampled rows has none.
    """
    left, right, feature, cut = structure(text, features)
    n = len(left)
    sums = np.zeros((n, 3))
    ends = [i for i in range(n) if left[i] < 0]
    for number, i in enumerate(ends):
        sums[i] = leaves.get(number, (0.0, 0.0, 0))
    for i in range(n - 1, -1, -1):
        if left[i] >= 0:
            sums[i] = sums[left[i]] + sums[right[i]]
    g, h = sums[:, 0], sums[:, 1]
    score = shrunk(g, o.reg_alpha) ** 2 / (h + o.reg_lambda + 1e-300)
    gain = np.zeros(n)
    whole = np.array(left) >= 0
    for i in np.flatnonzero(whole):
        gain[i] = score[left[i]] + score[right[i]] - score[i]
        whole[i] = min(h[left[i]], h[right[i]]) >= o.min_child_weight
    for i in range(n - 1, -1, -1):  # children come after their parents
        if whole[i] and gain[i] < o.gamma and not whole[left[i]] and not whole[right[i]]:
            whole[i] = False
    value = -o.learning_rate * shrunk(g, o.reg_alpha) / (h + o.reg_lambda + 1e-300)
    # the nodes that stay, and the leaf that each fitted leaf now belongs to
    place, owner, todo, order = np.full(n, -1), np.zeros(n, np.int64), [(0, -1)], []
    while todo:
        i, top = todo.pop()
        if top < 0:
            place[i] = len(order)
            order.append(i)
        owner[i] = i if top < 0 else top
        if left[i] >= 0:
            below = owner[i] if top >= 0 or not whole[i] else -1
            todo += [(right[i], below), (left[i], below)]
    keep = np.array(order)
    inner = whole[keep]

    def child(side: list[int]) -> np.ndarray:
        return np.where(inner, place[np.where(inner, np.array(side)[keep], 0)], -1)

    tree = Tree(
        child(left), child(right), np.where(inner, np.array(feature)[keep], -1), np.where(inner, np.array(cut)[keep], 0.0),
        g[keep], h[keep], sums[keep, 2], np.where(inner, 0.0, value[keep]), np.where(inner, gain[keep], 0.0),
    )
    return tree, value[owner[ends]]


# --- fitting -----------------------------------------------------------------------------


def softmax(margins: Column) -> Column:
    top = F.array_max(margins)
    powers = F.transform(margins, lambda m: F.exp(m - top))
    return F.transform(powers, lambda e: e / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


class _BoostParams(Params):
    labelCol = Param(Params._dummy(), "labelCol", "class number", TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "row weight", TypeConverters.toString)
    keyCol = Param(Params._dummy(), "keyCol", "row key", TypeConverters.toString)
    numClasses = Param(Params._dummy(), "numClasses", "number of classes", TypeConverters.toInt)


class JointBooster(Estimator, _BoostParams):
    """Fits ``JointBoostingModel`` on column ``features``."""

    def __init__(self, options: BoostOptions, n_classes: int, labelCol: str, weightCol: str | None = None, keyCol: str | None = None):
        super().__init__()
        self._set(labelCol=labelCol, numClasses=n_classes)
        if weightCol is not None:
            self._set(weightCol=weightCol)
        if keyCol is not None:
            self._set(keyCol=keyCol)
        self.options = options

    def _fit(self, dataset: DataFrame) -> JointBoostingModel:
        o, n_classes = self.options, self.getOrDefault(self.numClasses)
        n_margins = 1 if n_classes == 2 else n_classes
        label = F.col(self.getOrDefault(self.labelCol))
        weight = F.col(self.getOrDefault(self.weightCol)) if self.isSet(self.weightCol) else F.lit(1.0)
        key = F.col(self.getOrDefault(self.keyCol)) if self.isSet(self.keyCol) else F.struct(vector_to_array("features"), label)
        rows = dataset.select(
            "features", label.cast("int").alias("y"), weight.cast("double").alias("w"), F.xxhash64(key).alias("k"),
            F.array(*[F.lit(0.0)] * n_margins).alias("margins"),
        ).where("y is not null and w > 0")
        rows = written(rows, "boost")
        first = rows.select("features").first()
        model = JointBoostingModel(n_classes, 0 if first is None else first["features"].size)
        if first is None:
            return model
        rng, held = random.Random(o.seed), None
        with ThreadPool(processes=min(n_margins, 8)) as pool:
            for number in range(o.n_estimators):
                now = _with_gradient(rows, n_classes).persist(StorageLevel.MEMORY_AND_DISK)
                sampled = now
                if o.subsample < 1.0:
                    unit = F.pmod(F.xxhash64("k", F.lit(o.seed), F.lit(number)), F.lit(1 << 30)) / float(1 << 30)
                    sampled = now.where(unit < o.subsample)
                share = max(1, round(o.colsample_bytree * model.n_features))
                chosen = [None if share == model.n_features else sorted(rng.sample(range(model.n_features), share)) for _ in range(n_margins)]
                fitted = pool.map(
                    inheritable_thread_target(now.sparkSession)(lambda c: _fit_tree(sampled, c, chosen[c], o)), range(n_margins)
                )
                placed = now
                for c, (tree, features) in enumerate(fitted):
                    if features is not None:
                        placed = VectorSlicer(inputCol="features", outputCol=f"_s{c}", indices=features).transform(placed)
                    placed = tree.transform(placed).drop("_p", f"_s{c}")
                leaf = F.array(*[F.col(f"_l{c}").cast("int") for c in range(n_margins)])
                placed = placed.withColumn("leaf", leaf).drop(*[f"_l{c}" for c in range(n_margins)])
                sums = _leaf_sums(placed if o.subsample >= 1.0 else placed.where(unit < o.subsample))
                values = []
                for c, (tree, features) in enumerate(fitted):
                    nodes, at_leaf = settled(tree.toDebugString, features, sums.get(c, {}), o)
                    model.add(number, c, nodes)
                    values.append(F.array(*[F.lit(float(v)) for v in at_leaf]))
                step = F.transform("margins", lambda m, c: m + F.element_at(F.element_at(F.array(*values), c + 1), F.element_at("leaf", c + 1) + 1))
                rows = placed.select("features", "y", "w", "k", step.alias("margins"))
                if (number + 1) % CUT == 0:
                    rows = written(rows, "boost")
                    now.unpersist()
                if held is not None:
                    held.unpersist()
                held = now
        if held is not None:
            held.unpersist()
        return model


def _with_gradient(rows: DataFrame, n_classes: int) -> DataFrame:
    """Columns ``g`` and ``h``: weighted gradient and curvature of the loss by margin."""
    if n_classes == 2:
        p = F.transform("margins", sigmoid)
        g = F.transform("p", lambda x: (x - F.col("y")) * F.col("w"))
        h = F.transform("p", lambda x: F.greatest(x * (1 - x), F.lit(1e-16)) * F.col("w"))
    else:
        p = softmax(F.col("margins"))
        g = F.transform("p", lambda x, i: (x - (F.col("y") == i).cast("double")) * F.col("w"))
        # twice the diagonal, a bound on the curvature of the classes together
        h = F.transform("p", lambda x: F.greatest(2 * x * (1 - x), F.lit(1e-16)) * F.col("w"))
    return rows.withColumn("p", p).withColumns({"g": g, "h": h}).drop("p")


def _fit_tree(rows: DataFrame, c: int, features: list[int] | None, o: BoostOptions):
    column = "features"
    if features is not None:
        rows = VectorSlicer(inputCol="features", outputCol=f"_s{c}", indices=features).transform(rows)
        column = f"_s{c}"
    data = rows.select(column, (-F.col("g")[c] / F.col("h")[c]).alias("_t"), F.col("h")[c].alias("_h"))
    learner = DecisionTreeRegressor(
        featuresCol=column, labelCol="_t", weightCol="_h", predictionCol="_p", leafCol=f"_l{c}", maxDepth=o.max_depth, maxBins=BINS, seed=o.seed
    )
    return learner.fit(data), features


def _leaf_sums(placed: DataFrame) -> dict[int, dict[int, tuple[float, float, int]]]:
    """G, H and rows by class and leaf, in one grouped sum."""
    each = placed.select(F.posexplode(F.arrays_zip("leaf", "g", "h")).alias("c", "e"))
    sums = each.groupBy("c", F.col("e.leaf").alias("leaf")).agg(F.sum("e.g").alias("g"), F.sum("e.h").alias("h"), F.count("*").alias("n"))
    out: dict[int, dict[int, tuple[float, float, int]]] = {}
    for r in sums.collect():  # classes x leaves
        out.setdefault(r["c"], {})[r["leaf"]] = (r["g"], r["h"], r["n"])
    return out


# --- the model ---------------------------------------------------------------------------

TABLE = (
    "round int, class int, node int, left int, right int, feature int, cut double, gradient double, curvature double, rows long, value double, gain double"
)


class JointBoostingModel(Model, MLWritable, MLReadable):
    """Trees by round and class; adds ``probability`` and ``prediction``."""

    def __init__(self, n_classes: int = 2, n_features: int = 0):
        super().__init__()
        self.n_classes, self.n_features = n_classes, n_features
        self.trees: list[tuple[int, int, Tree]] = []

    def add(self, number: int, c: int, tree: Tree) -> None:
        self.trees.append((number, c, tree))

    def rows(self) -> pd.DataFrame:
        names = [n.split()[0] for n in TABLE.split(", ")]
        parts = []
        for number, c, t in self.trees:
            n = len(t.left)
            parts.append(pd.DataFrame({
                "round": np.full(n, number, np.int32), "class": np.full(n, c, np.int32), "node": np.arange(n, dtype=np.int32),
                "left": t.left.astype(np.int32), "right": t.right.astype(np.int32), "feature": t.feature.astype(np.int32), "cut": t.cut,
                "gradient": t.gradient, "curvature": t.curvature, "rows": t.rows.astype(np.int64), "value": t.value, "gain": t.gain,
            }))
        return pd.concat(parts)[names] if parts else pd.DataFrame({n: [] for n in names})

    def node_rows(self) -> DataFrame:
        """The nodes of all trees as a table."""
        spark = current()
        return spark.createDataFrame(list(self.rows().itertuples(index=False, name=None)), TABLE)

    def nodes_of(self, class_index: int) -> DataFrame:
        """Nodes that make the margin of a class; that of the first of two classes is the other's, negated."""
        mine, sign = (0, 1.0 if class_index == 1 else -1.0) if self.n_classes == 2 else (class_index, 1.0)
        own = self.node_rows().where(F.col("class") == mine)
        return own.select(
            F.col("round").alias("tree"), "node", "left", "right", "feature", "cut", F.col("curvature").alias("cover"), (F.col("value") * sign).alias("value")
        )

    def _margins(self):
        """A column function from the features to the margins of all classes."""
        used = sorted({int(f) for _, _, t in self.trees for f in t.feature if f >= 0})
        place = {f: i for i, f in enumerate(used)}
        n_margins = 1 if self.n_classes == 2 else self.n_classes
        starts = np.cumsum([0, *(len(t.left) for _, _, t in self.trees)])
        left = np.concatenate([np.zeros(0, np.int64), *(np.where(t.left < 0, np.arange(len(t.left)), t.left) + s for (_, _, t), s in zip(self.trees, starts))])
        right = np.concatenate([np.zeros(0, np.int64), *(np.where(t.left < 0, np.arange(len(t.left)), t.right) + s for (_, _, t), s in zip(self.trees, starts))])
        feature = np.concatenate([np.zeros(0, np.int64), *(np.array([place.get(int(f), 0) for f in t.feature], np.int64) for _, _, t in self.trees)])
        cut = np.concatenate([np.zeros(0), *(t.cut for _, _, t in self.trees)])
        value = np.concatenate([np.zeros(0), *(t.value for _, _, t in self.trees)])
        classes = np.array([c for _, c, _ in self.trees], np.int64)
        roots = starts[:-1]
        leaf = left == np.arange(len(left))

        def score(x: np.ndarray) -> np.ndarray:
            out = np.zeros((len(x), n_margins))
            step = max(1, CHUNK // max(1, len(roots)))
            for a in range(0, len(x), step):
                part = x[a : a + step]
                at = np.tile(roots, (len(part), 1))
                row = np.arange(len(part))[:, None]
                while len(roots) and not leaf[at].all():
                    at = np.where(part[row, feature[at]] <= cut[at], left[at], right[at])
                for c in range(n_margins):
                    out[a : a + step, c] = value[at[:, classes == c]].sum(axis=1)
            return out

        @F.pandas_udf("array<double>")
        def margins(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                x = np.stack(batch.to_numpy()) if len(batch) and used else np.zeros((len(batch), 1))
                yield pd.Series(list(score(x)))

        x = vector_to_array("features")
        picked = F.transform(F.array(*[F.lit(f) for f in used]), lambda f: F.element_at(x, f + 1)) if used else F.array(F.lit(0.0))
        return margins(picked)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = dataset.withColumn("_m", self._margins())
        p = F.transform("_m", sigmoid) if self.n_classes == 2 else softmax(F.col("_m"))
        shares = F.array(1 - F.col("_q")[0], F.col("_q")[0]) if self.n_classes == 2 else F.col("_q")
        raw = F.array(-F.col("_m")[0], F.col("_m")[0]) if self.n_classes == 2 else F.col("_m")
        out = out.withColumn("_q", p).withColumn("_shares", shares)
        best = (F.array_position("_shares", F.array_max("_shares")) - 1).cast("double")
        return out.withColumns({"rawPrediction": array_to_vector(raw), "probability": array_to_vector("_shares"), "prediction": best}).drop("_m", "_q", "_shares")

    @property
    def featureImportances(self) -> np.ndarray:
        """Gain by feature, scaled to sum to one."""
        total = np.zeros(self.n_features)
        for _, _, t in self.trees:
            np.add.at(total, t.feature[t.left >= 0], t.gain[t.left >= 0])
        return total / total.sum() if total.sum() > 0 else total

    def write(self) -> MLWriter:
        return _BoostWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _BoostReader()


class _BoostWriter(MLWriter):
    def __init__(self, instance: JointBoostingModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        extra = {"classes": self.instance.n_classes, "features": self.instance.n_features}
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata=extra)
        self.instance.node_rows().coalesce(1).write.parquet(f"{path}/nodes")


class _BoostReader(MLReader):
    def load(self, path: str) -> JointBoostingModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = JointBoostingModel(metadata["classes"], metadata["features"])
        nodes = self.sparkSession.read.schema(TABLE).parquet(f"{path}/nodes").orderBy("round", "class", "node")
        table = pd.DataFrame(nodes.collect(), columns=nodes.columns)  # bounded by the options of the model
        for (number, c), part in table.groupby(["round", "class"], sort=True):
            columns = (part[n].to_numpy() for n in ("left", "right", "feature", "cut", "gradient", "curvature", "rows", "value", "gain"))
            model.add(int(number), int(c), Tree(*columns))
        model._resetUid(metadata["uid"])
        return model
