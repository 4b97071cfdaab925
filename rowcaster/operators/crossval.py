"""Out-of-fold prediction: every row is scored by the model that did not see it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .features import FeatureModel, FeatureOptions, fit_features
from .folds import group_class_folds, group_folds, plain_folds, stratified_folds
from .models import fit_classifier, probabilities, uses_weights


@dataclass
class FoldedData:
    """The training table with fold numbers, written once and split by fold on disk."""

    df: DataFrame
    features: list[FeatureModel]  # per fold, learned without that fold
    counts: list[dict[int, int]]  # class counts of the training part per fold
    label: str
    n_classes: int
    key: str | None = None

    @property
    def k(self) -> int:
        return len(self.features)

    def train(self, i: int) -> DataFrame:
        return self.df.where(F.col("fold") != i)

    def test(self, i: int) -> DataFrame:
        return self.df.where(F.col("fold") == i)


def prepare_folds(
    df: DataFrame,
    options: FeatureOptions,
    label: str,
    key: str,
    n_classes: int,
    k: int = 5,
    seed: int = 42,
    group: str | None = None,
    stratify: bool = True,
    exclude: Sequence[str] = (),
) -> FoldedData:
    """Number the rows, write them, and learn the features of all k training parts together."""
    if group is not None:
        folded = group_class_folds(df, label, group, k, seed) if stratify else group_folds(df, group, k, seed)
    elif stratify:
        folded = stratified_folds(df, label, key, k, seed)
    else:
        folded = plain_folds(df, key, k, seed)
    folded = written(folded, "folds", partition_by="fold")
    table = folded.groupBy("fold", label).agg(F.count("*").alias("n")).collect()  # k x classes rows
    counts: list[dict[int, int]] = [{} for _ in range(k)]
    for r in table:
        for i in range(k):
            if r["fold"] != i:
                counts[i][int(r[label])] = counts[i].get(int(r[label]), 0) + r["n"]
    skip = [key, label, "fold", *exclude]
    states = fit_features(folded, options, skip, [F.col("fold") != i for i in range(k)])
    return FoldedData(folded, [FeatureModel(s) for s in states], counts, label, n_classes, key)


def fit_folds(
    data: FoldedData, config: dict, weighted: bool | None = None, parallelism: int = 2
) -> list[PipelineModel]:
    """One classifier per fold; ``parallelism`` of them are fitted at the same time."""
    weighted = uses_weights(config, False) if weighted is None else weighted

    def fit(i: int) -> PipelineModel:
        return fit_classifier(
            data.train(i), data.features[i], config, data.label, data.counts[i], data.n_classes, weighted, data.key
        )

    with ThreadPool(processes=max(1, min(parallelism, data.k))) as pool:
        return pool.map(inheritable_thread_target(data.df.sparkSession)(fit), range(data.k))


def out_of_fold(data: FoldedData, models: Sequence[PipelineModel], out: str = "proba") -> DataFrame:
    """All rows with the probabilities of their own fold's model."""
    parts = [probabilities(models[i], data.test(i), out) for i in range(data.k)]
    return reduce(lambda a, b: a.unionByName(b), parts)
