"""Exact ranking metrics without a window over the whole table.

Rows are first merged by score (ties and hot scores collapse before the shuffle). The
distinct scores are then cut into buckets of about equal size by a sketch; running sums
are local to a bucket and bucket totals add the offsets. The result is the same for any
choice of buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .confusion import f1_of_counts
from .quantiles import count_and_splits, linear_quantiles, with_bucket

BUCKET_ROWS, MOST_BUCKETS = 100_000, 100_000  # the bounds are a sample's quantiles, so some millions of rows at most
THRESHOLD_LEVELS = [*(0.01 + i * ((0.99 - 0.01) / 198) for i in range(198)), 0.99]


def class_scores(
    df: DataFrame, y: str, proba: str, n_classes: int, classes: Sequence | None = None
) -> DataFrame:
    """(cls, score, pos): every row once per class, pos = 1 where the row is of the class."""
    labels = list(range(n_classes)) if classes is None else list(classes)
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("cls"),
                F.col(proba)[i].cast("double").alias("score"),
                (F.col(y) == F.lit(v)).cast("long").alias("pos"),
            )
            for i, v in enumerate(labels)
        ]
    )
    return df.select(F.inline(entries))


def binary_scores(df: DataFrame, y: str, score: str) -> DataFrame:
    return df.select(
        F.lit(0).alias("cls"),
        F.col(score).cast("double").alias("score"),
        (F.col(y) == 1).cast("long").alias("pos"),
    )


def label_scores(df: DataFrame, truth: Sequence[str], scores: Sequence[str]) -> DataFrame:
    """(cls, score, pos) for independent 0/1 labels."""
    entries = F.array(
        *[
            F.struct(
                F.lit(i).alias("cls"), F.col(s).cast("double").alias("score"), F.col(t).cast("long").alias("pos")
            )
            for i, (t, s) in enumerate(zip(truth, scores))
        ]
    )
    return df.select(F.inline(entries))


def score_bounds(long: DataFrame, buckets: int | None) -> list[float]:
    """Bounds of buckets, as many as the counted rows call for, from a sample of the scores."""
    if buckets is not None:
        return count_and_splits(long, "score", [i / buckets for i in range(1, buckets)])[1]
    n = long.where(F.col("score").isNotNull()).count()
    wanted = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    return count_and_splits(long, "score", [i / wanted for i in range(1, wanted)])[1] if wanted > 1 else []


def _score_counts(long: DataFrame, sums: Sequence[Column], buckets: int | None) -> DataFrame:
    """One row per class and distinct score. A NaN score fails the job, a NULL ranks lowest.

    Buckets follow from the number of rows, and their bounds from a sample of the scores.
    The keys are made non-nullable so that plans reading this twice share one shuffle.
    """
    splits = score_bounds(long, buckets)
    counts = with_bucket(long.groupBy("cls", "score").agg(*sums), "score", splits, "_b")
    return counts.withColumns(
        {
            "cls": F.coalesce("cls", F.lit(-1)),
            "bucket": F.coalesce("_b", F.lit(-1.0)),
        }
    ).drop("_b")


def _running(keys: Sequence[str], order: Column | str) -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _before(column: str, window) -> Column:
    return F.coalesce(F.sum(column).over(window), F.lit(0.0))


def auc_by_class(long: DataFrame, buckets: int | None = None) -> DataFrame:
    """(cls, auc) from (cls, score, pos); NULL for a class without positives or negatives."""
    counts = _score_counts(
        long,
        [F.sum("pos").cast("double").alias("pos"), F.sum(1 - F.col("pos")).cast("double").alias("neg")],
        buckets,
    )
    local = _running(["cls", "bucket"], "score")
    per_bucket = (
        counts.withColumn("below", _before("neg", local))
        .groupBy("cls", "bucket")
        .agg(
            F.sum("pos").alias("pos"),
            F.sum("neg").alias("neg"),
            F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("inner"),
        )
    )
    return (
        per_bucket.withColumn("below", _before("neg", _running(["cls"], "bucket")))
        .groupBy("cls")
        .agg(
            F.sum(F.col("inner") + F.col("pos") * F.col("below")).alias("wins"),
            F.sum("pos").alias("p"),
            F.sum("neg").alias("n"),
        )
        .select(
            "cls",
            F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("wins") / F.col("p") / F.col("n")).alias("auc"),
        )
    )


def roc_auc(df: DataFrame, y: str, score: str, buckets: int | None = None) -> DataFrame:
    return auc_by_class(binary_scores(df, y, score), buckets).select(F.col("auc").alias("roc_auc"))


def _macro(by_class: DataFrame, value: str, out: str) -> DataFrame:
    """Mean over the classes, NULL if any class has none."""
    return by_class.agg(
        F.when(F.count(value) == F.count("*"), F.avg(value)).alias(out)
    )


def roc_auc_ovr(df: DataFrame, y: str, proba: str, n_classes: int, buckets: int | None = None) -> DataFrame:
    return _macro(auc_by_class(class_scores(df, y, proba, n_classes), buckets), "auc", "roc_auc_ovr")


def roc_auc_multilabel(
    df: DataFrame, truth: Sequence[str], scores: Sequence[str], buckets: int | None = None
) -> DataFrame:
    """Mean of the per-label areas; use ``auc_by_class(label_scores(...))`` for each."""
    return _macro(auc_by_class(label_scores(df, truth, scores), buckets), "auc", "roc_auc_macro")


def roc_auc_ovo(df: DataFrame, y: str, proba: str, n_classes: int, buckets: int | None = None) -> DataFrame:
    """Mean over ordered class pairs (a, b) of the area of score a on the rows of a and b.

    Rows are merged to one count per true class for each distinct score, so the pairs are
    formed from K columns of the merged table and never from rows.
    """
    entries = F.array(
        *[
            F.struct(F.lit(i).alias("cls"), F.col(proba)[i].cast("double").alias("score"), F.col(y).alias("y"))
            for i in range(n_classes)
        ]
    )
    long = df.select(F.inline(entries))
    names = [f"n{j}" for j in range(n_classes)]
    own = F.element_at(F.array(*names), F.col("cls") + 1)
    counts = _score_counts(
        long, [F.count_if(F.col("y") == j).cast("double").alias(n) for j, n in enumerate(names)], buckets
    ).withColumn("own", own)
    local = _running(["cls", "bucket"], "score")
    below = {f"b{j}": _before(n, local) for j, n in enumerate(names)}
    per_bucket = (
        counts.withColumns(below)
        .groupBy("cls", "bucket")
        .agg(
            F.sum("own").alias("own"),
            *[F.sum(n).alias(n) for n in names],
            *[
                F.sum(F.col("own") * (F.col(f"b{j}") + F.col(n) / 2)).alias(f"w{j}")
                for j, n in enumerate(names)
            ],
        )
    )
    outer = _running(["cls"], "bucket")
    per_class = (
        per_bucket.withColumns({f"b{j}": _before(n, outer) for j, n in enumerate(names)})
        .groupBy("cls")
        .agg(
            F.sum("own").alias("own"),
            *[F.sum(n).alias(n) for n in names],
            *[
                F.sum(F.col(f"w{j}") + F.col("own") * F.col(f"b{j}")).alias(f"w{j}")
                for j in range(n_classes)
            ],
        )
    )
    pairs = F.array(
        *[
            F.struct(F.lit(j).alias("other"), F.col(f"w{j}").alias("wins"), F.col(n).alias("n"))
            for j, n in enumerate(names)
        ]
    )
    auc = F.when((F.col("own") > 0) & (F.col("n") > 0), F.col("wins") / F.col("own") / F.col("n"))
    each = (
        per_class.select("cls", "own", F.inline(pairs))
        .where(F.col("cls") != F.col("other"))
        .select(auc.alias("auc"))
    )
    return _macro(each, "auc", "roc_auc_ovo")


def average_precision_by_class(long: DataFrame, n_classes: int, buckets: int | None = None) -> DataFrame:
    """(cls, ap): sum over distinct scores, from the highest, of recall gain times precision."""
    counts = _score_counts(
        long,
        [F.sum("pos").cast("double").alias("pos"), F.sum(1 - F.col("pos")).cast("double").alias("neg")],
        buckets,
    )
    totals = counts.groupBy("cls", "bucket").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    higher = _running(["cls"], F.desc("bucket"))
    whole = Window.partitionBy("cls")
    offsets = totals.select(
        "cls",
        "bucket",
        _before("bp", higher).alias("tp_above"),
        _before("bn", higher).alias("fp_above"),
        F.sum("bp").over(whole).alias("p"),
    )
    local = (
        Window.partitionBy("cls", "bucket").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    )
    tp = F.col("tp_above") + F.col("tp_in")
    fp = F.col("fp_above") + F.col("fp_in")
    return (
        counts.withColumns({"tp_in": F.sum("pos").over(local), "fp_in": F.sum("neg").over(local)})
        .join(offsets, ["cls", "bucket"])
        .groupBy("cls")
        .agg(
            F.sum(F.col("pos") * tp / (tp + fp)).alias("gain"),
            F.max("p").alias("p"),
        )
        .select("cls", F.when(F.col("p") > 0, F.col("gain") / F.col("p")).alias("ap"))
    )


def average_precision(df: DataFrame, y: str, score: str, buckets: int | None = None) -> DataFrame:
    return average_precision_by_class(binary_scores(df, y, score), 1, buckets).select(
        F.col("ap").alias("pr_auc")
    )


def average_precision_macro(
    df: DataFrame, y: str, proba: str, n_classes: int, buckets: int | None = None
) -> DataFrame:
    return _macro(
        average_precision_by_class(class_scores(df, y, proba, n_classes), n_classes, buckets), "ap", "pr_auc"
    )


def best_f1_threshold(
    df: DataFrame, y: str, score: str, levels: Sequence[float] = THRESHOLD_LEVELS
) -> tuple[float, float]:
    """(threshold, f1) over the score quantiles; the lowest threshold wins a tie.

    Counts per interval between thresholds come from one grouped count of at most
    ``len(levels) + 1`` rows.
    """
    scored = binary_scores(df, y, score).select("score", "pos")
    thresholds = sorted(set(linear_quantiles(scored, "score", levels)))
    best_threshold, best = 0.5, -1.0
    if not thresholds:
        return best_threshold, best
    rows = (
        with_bucket(scored, "score", thresholds, "bucket")
        .groupBy("bucket")
        .agg(F.sum("pos").alias("pos"), F.sum(1 - F.col("pos")).alias("neg"))
        .collect()
    )
    # bucket i lies at or above i thresholds
    pos, neg = [0] * (len(thresholds) + 1), [0] * (len(thresholds) + 1)
    for r in rows:
        pos[int(r["bucket"])], neg[int(r["bucket"])] = r["pos"], r["neg"]
    total = sum(pos)
    tp, fp = total, sum(neg)
    for i, t in enumerate(thresholds):
        tp, fp = tp - pos[i], fp - neg[i]
        value = f1_of_counts(tp, fp, total - tp)
        if value > best:
            best_threshold, best = t, value
    return best_threshold, best
