"""One table of scores from which areas, precision, thresholds and calibrators are all read.

Rows are merged by (fold, class, score) before and in one shuffle, cut into buckets of the
score, and written with the sums that run below them inside their bucket. A table of one row
per class and bucket adds what lies in other buckets. After that every metric is a scan of the
written table and of that small one, and no row of the data moves again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .confusion import f1_of_counts
from .rankmetrics import THRESHOLD_LEVELS, binary_scores, class_scores, score_bounds
from .quantiles import with_bucket

BROADCAST_TOTALS = 500_000  # rows of a class and a bucket, five numbers each


@dataclass
class ScoreTable:
    """``rows``: (fold, cls, bucket, score, pos, neg, pos_below, neg_below, pos_tied, neg_tied), the last four over all folds
    within the class and bucket; ``totals``: (cls, bucket, pos_before, neg_before, pos_after, neg_after, p, n)."""

    rows: DataFrame
    totals: DataFrame
    few: bool

    def _placed(self) -> DataFrame:
        return self.rows.join(F.broadcast(self.totals) if self.few else self.totals, ["cls", "bucket"])

    def areas(self) -> DataFrame:
        """(cls, auc); null without positives or negatives."""
        wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg_below") + F.col("neg_tied") / 2))
        sums = self._placed().groupBy("cls").agg(wins.alias("wins"), F.max("p").alias("p"), F.max("n").alias("n"))
        return sums.select("cls", F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("wins") / F.col("p") / F.col("n")).alias("auc"))

    def precisions(self) -> DataFrame:
        """(cls, ap); null without positives."""
        tp = F.col("pos_after") + F.col("pos_in") - F.col("pos_below")
        fp = F.col("neg_after") + F.col("neg_in") - F.col("neg_below")
        # rows of one score in several folds share its precision
        gain = F.sum(F.col("pos") * tp / (tp + fp))
        sums = self._placed().groupBy("cls").agg(gain.alias("gain"), F.max("p").alias("p"))
        return sums.select("cls", F.when(F.col("p") > 0, F.col("gain") / F.col("p")).alias("ap"))

    def quantiles(self, levels: Sequence[float], cls: int = 0) -> list[float | None]:
        """Linearly interpolated quantiles of the scores of a class."""
        own = self._placed().where(F.col("cls") == cls)
        total = self.totals.where(F.col("cls") == cls).agg(F.max(F.col("p") + F.col("n"))).first()[0]
        if not total:
            return [None] * len(levels)
        at = [q * (int(total) - 1) for q in levels]
        ranks = sorted({r for a in at for r in (int(a), min(int(a) + 1, int(total) - 1))})
        before = F.col("pos_before") + F.col("neg_before") + F.col("pos_below") + F.col("neg_below")
        upto = before + F.col("pos_tied") + F.col("neg_tied")
        wanted = F.array(*[F.lit(float(r)) for r in ranks])
        hit = F.filter(wanted, lambda r: (r >= before) & (r < upto))
        values = dict(own.where(F.size(hit) > 0).select(F.explode(hit).alias("r"), "score").distinct().collect())  # one row per rank
        out = []
        for a in at:
            low, high = values[int(a)], values[min(int(a) + 1, int(total) - 1)]
            out.append(low + (a - int(a)) * (high - low))
        return out

    def best_threshold(self, levels: Sequence[float] = THRESHOLD_LEVELS, cls: int = 0) -> tuple[float, float]:
        """(threshold, f1) over the quantiles of the scores; the lowest threshold wins a tie."""
        thresholds = sorted({q for q in self.quantiles(levels, cls) if q is not None})
        best_threshold, best = 0.5, -1.0
        if not thresholds:
            return best_threshold, best
        own = with_bucket(self.rows.where(F.col("cls") == cls).select("score", "pos", "neg"), "score", thresholds, "step")
        pos, neg = [0.0] * (len(thresholds) + 1), [0.0] * (len(thresholds) + 1)
        for r in own.groupBy("step").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect():
            pos[int(r["step"])], neg[int(r["step"])] = r["pos"], r["neg"]
        total = sum(pos)
        tp, fp = total, sum(neg)
        for i, t in enumerate(thresholds):
            tp, fp = tp - pos[i], fp - neg[i]
            value = f1_of_counts(tp, fp, total - tp)
            if value > best:
                best_threshold, best = t, value
        return best_threshold, best

    def merged(self, folds: Column | None = None, cls: int = 0) -> DataFrame:
        """(s, n, p): rows and positives of each score, of all or the chosen folds."""
        own = self.rows.where(F.col("cls") == cls)
        if folds is not None:
            own = own.where(folds)
        return own.groupBy(F.col("score").alias("s")).agg(F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum("pos").alias("p"))


def score_table(long: DataFrame, buckets: int | None = None) -> ScoreTable:
    """From (cls, score, pos) and, where there is one, fold. A NaN score fails the job, a null ranks lowest."""
    if "fold" not in long.columns:
        long = long.withColumn("fold", F.lit(0))
    splits = score_bounds(long, buckets)
    merged = long.groupBy("cls", "fold", "score").agg(F.sum("pos").cast("double").alias("pos"), F.sum(1 - F.col("pos")).cast("double").alias("neg"))
    placed = with_bucket(merged, "score", splits, "_b").withColumn("bucket", F.coalesce("_b", F.lit(-1.0))).drop("_b")
    tied = Window.partitionBy("cls", "bucket", "score")
    upto = Window.partitionBy("cls", "bucket").orderBy("score").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sums = placed.withColumns({f"{c}_upto": F.sum(c).over(upto) for c in ("pos", "neg")})
    sums = sums.withColumns({f"{c}_tied": F.sum(c).over(tied) for c in ("pos", "neg")})
    below = {f"{c}_below": F.col(f"{c}_upto") - F.col(f"{c}_tied") for c in ("pos", "neg")}
    rows = written(sums.withColumns(below).drop("pos_upto", "neg_upto"), "scores")
    inside = rows.groupBy("cls", "bucket").agg(F.sum("pos").alias("pos_in"), F.sum("neg").alias("neg_in"))
    whole = Window.partitionBy("cls")
    earlier = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    totals = inside.withColumns({f"{c}_before": F.coalesce(F.sum(f"{c}_in").over(earlier), F.lit(0.0)) for c in ("pos", "neg")})
    totals = totals.withColumns({"p": F.sum("pos_in").over(whole), "n": F.sum("neg_in").over(whole)})
    after = {f"{c}_after": F.col(t) - F.col(f"{c}_before") - F.col(f"{c}_in") for c, t in (("pos", "p"), ("neg", "n"))}
    totals = written(totals.withColumns(after), "score-totals")
    return ScoreTable(rows, totals, totals.count() <= BROADCAST_TOTALS)


def binary_table(df: DataFrame, y: str, score: str, buckets: int | None = None) -> ScoreTable:
    return score_table(binary_scores(df, y, score), buckets)


def class_table(df: DataFrame, y: str, proba: str, n_classes: int, buckets: int | None = None) -> ScoreTable:
    return score_table(class_scores(df, y, proba, n_classes), buckets)


def mean_of(by_class: DataFrame, value: str) -> float | None:
    """Mean over the classes, None if any class has none."""
    return by_class.agg(F.when(F.count(value) == F.count("*"), F.avg(value))).first()[0]
