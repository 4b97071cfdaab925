"""Quality rules: robust multivariate outliers by language and source.

Base statistics are counted on whole texts. Each document then has a vector of transformed
statistics; for every (language, source) the minimum-covariance-determinant estimate of
location and scatter is found by concentration steps over all its documents, from two
starts of which the one with the smaller determinant wins. Steps go on until the determinants
of all groups have settled. The scatter is made consistent for
normal statistics, and the square of a least deviation of each statistic's own is added to it.
Documents whose squared Mahalanobis distance is beyond a quantile of the chi-square law are
rejected, besides those that the base rule fails.

A concentration step is two aggregations by group: the quantile of the distances, and sums
of products of the rows within it. Only one row per group, the estimate, is inverted.

Defined results: a null text has no words, all counts 0, and fails the base rule. Null is a
language or source of its own. Groups of fewer than ``least`` judged documents are pooled by
language, then over all. Documents that fail the base rule take no part in the estimates.
Rows with equal ``doc_id`` are judged one by one. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import written
from . import text as T
from .frames import bounded, join_small

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
REPEAT = 8

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


@dataclass(frozen=True)
class OutlierOptions:
    half: float = 0.75  # share of a group that the estimate rests on
    still: float = 1e-3  # change of a log-determinant below which a group's estimate has settled
    most_steps: int = 30  # steps after which the better start is taken as it is
    least: int = 60
    quantile: float = 0.9999  # of the chi-square law, beyond which a squared distance is far out
    # least deviation of each statistic; most texts repeat nothing at all. Where nobody else has any,
    # 3.3 symbols in 100 words, 20% of the lines or 17% of the words repeated are beyond the quantile
    floors: tuple[float, ...] = (0.1, 0.1, 0.2, 0.08, 0.08)

    @property
    def cutoff(self) -> float:
        return chi_square_quantile(self.quantile, D)

    @property
    def consistency(self) -> float:
        """Variance of a normal law over that of its central share ``half``."""
        return self.half / chi_square(chi_square_quantile(self.half, D), D + 2)


def chi_square(x: float, k: int) -> float:
    """Distribution function of the chi-square law with an odd number of degrees."""
    p = math.erf(math.sqrt(x / 2))
    for j in range(1, k, 2):
        p -= (x / 2) ** (j / 2) * math.exp(-x / 2) / math.gamma(j / 2 + 1)
    return p


def chi_square_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, k) < p else (low, middle)
    return high


def count_texts(texts: pa.Array) -> dict[str, np.ndarray]:
    """Base statistics of each text of a batch."""
    b = T.batch_of(texts)
    w = T.words(b)
    inside = ~T.SPACE[b.data]
    lines = T.segments(b, b.data != 0x0A)
    sums = np.zeros(len(b.data) + 1, np.int64)
    np.cumsum(inside, out=sums[1:])
    worded = sums[lines.end] > sums[lines.start]
    owner = lines.text_of()
    again = repeats(owner[worded], T.span_hash(b.data, lines.start[worded], lines.end[worded]))
    dup_lines = np.bincount(owner[worded][again], minlength=len(b)).astype(np.int64)
    h = T.span_hash(b.data, w.start, w.end)
    runs = T.run_hash(h, REPEAT)
    begins = np.flatnonzero(T.run_starts(w.first, REPEAT))
    text_of = w.text_of()
    hit = begins[repeats(text_of[begins], runs[begins], first_too=True)]
    return {
        "n_words": w.counts.astype(np.int64),
        "word_chars": T.per_text(inside & T.LEADS[b.data], b.offsets),
        "n_symbols": T.per_text(SYMBOLS[b.data], b.offsets),
        "n_dup_lines": dup_lines,
        "n_repeat_words": T.per_text(T.covered(hit, REPEAT, len(h)), w.first),
        "n_lines": np.bincount(owner[worded], minlength=len(b)).astype(np.int64),
    }


def repeats(owner: np.ndarray, value: np.ndarray, first_too: bool = False) -> np.ndarray:
    """Marks entries equal to an earlier one of the same owner, or to any other one."""
    order = np.lexsort((value, owner))  # stable, so the first of equals comes first
    o, v = owner[order], value[order]
    same = np.zeros(len(o), bool)
    same[1:] = (o[1:] == o[:-1]) & (v[1:] == v[:-1])
    if first_too:
        same[:-1] |= same[1:].copy()
    out = np.zeros(len(o), bool)
    out[order] = same
    return out


NEAR_ROWS = 1_000_000  # keys that are broadcast, 8 MB


def row_key() -> Column:
    """Equal for rows that are judged alike."""
    return F.xxhash64("doc_id", "lang", "source", "text")


def with_counts(documents: DataFrame) -> DataFrame:
    """(row, uid, text statistics): ``row`` holds all columns but the text."""
    rest = [F.col("`" + c.replace("`", "``") + "`") for c in documents.columns if c != "text"]
    source = documents.select(F.struct(*rest).alias("row"), row_key().alias("uid"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in T.slices(batch, "text"):
                counted = count_texts(piece.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("row"), piece.column("uid"), *[pa.array(counted[c], pa.int64()) for c in COUNTS]], ["row", "uid", *COUNTS]
                )

    return bounded(source).mapInArrow(run, StructType([source.schema["row"], *(StructField(c, LongType()) for c in ("uid", *COUNTS))]))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def vector() -> list[Column]:
    """Transformed statistics: logarithms of sizes, and square roots of shares."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log1p(F.col("n_words").cast("double")) / 4,
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.log1p(200 * F.col("n_symbols") / n) / 2,
        F.log1p(20 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))) / 4,
        F.sqrt(F.col("n_repeat_words") / n),
    ]


D = 5
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
KEYS = ["g_lang", "g_source"]
STARTS = 2


def _distance(start: int) -> Column:
    """Squared Mahalanobis distance to the estimate that goes on from a start."""
    x = [F.col(f"x{i}") - F.col(f"m{start}_{i}") for i in range(D)]
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + x[i] * x[j] * F.col(f"p{start}_{i}{j}") * (1 if i == j else 2)
    return total


def _inverted(mean: np.ndarray, cov: np.ndarray, floors: tuple[float, ...], start: int) -> dict[str, float]:
    cov = cov + np.diag(np.square(floors))
    inverse = np.linalg.inv(cov)
    out = {f"m{start}_{i}": float(mean[i]) for i in range(D)}
    out |= {f"p{start}_{i}{j}": float(inverse[i, j]) for i, j in PAIRS}
    return out | {f"det{start}": float(np.linalg.slogdet(cov)[1])}


ESTIMATE = "g_lang string, g_source string, " + ", ".join(
    ", ".join([f"m{s}_{i} double" for i in range(D)] + [f"p{s}_{i}{j} double" for i, j in PAIRS] + [f"det{s} double"])
    for s in range(STARTS)
)


def _estimates(moments: DataFrame, floors: tuple[float, ...], factor: float = 1.0) -> DataFrame:
    """Location and inverse scatter, ``factor`` times that of the sums, one row per group in and out."""

    names = [c.split()[0] for c in ESTIMATE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                out = {k: r[k] for k in KEYS}
                for s in range(STARTS):
                    mean = np.array([r[f"s{s}_{i}"] for i in range(D)])
                    cov = np.zeros((D, D))
                    for i, j in PAIRS:
                        cov[i, j] = cov[j, i] = r[f"c{s}_{i}{j}"] - mean[i] * mean[j]
                    out |= _inverted(mean, cov * factor, floors, s)
                rows.append(out)
            kinds = [pa.string() if n in KEYS else pa.float64() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds)], names)

    return moments.mapInArrow(run, ESTIMATE)


def _moments(rows: DataFrame, weights: list[Column]) -> DataFrame:
    """Weighted means of values and products by group, for each start."""
    parts = []
    for s, w in enumerate(weights):
        total = F.sum(w)
        parts += [(F.sum(w * F.col(f"x{i}")) / total).alias(f"s{s}_{i}") for i in range(D)]
        parts += [(F.sum(w * F.col(f"x{i}") * F.col(f"x{j}")) / total).alias(f"c{s}_{i}{j}") for i, j in PAIRS]
    return rows.groupBy(*KEYS).agg(*parts)


def _moved(last: DataFrame, now: DataFrame) -> float:
    """Largest change of a log-determinant between two tables of estimates."""
    dets = [f"det{s}" for s in range(STARTS)]
    before = last.select(*[F.col(k).alias(f"_{k}") for k in KEYS], *[F.col(d).alias(f"_{d}") for d in dets])
    both = now.join(before, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS])
    return both.agg(F.max(F.greatest(*[F.abs(F.col(d) - F.col(f"_{d}")) for d in dets]))).first()[0] or 0.0


def fit_outliers(judged: DataFrame, options: OutlierOptions = OutlierOptions()) -> DataFrame:
    """Estimates by group. ``judged``: (g_lang, g_source, x0..)."""
    middle = [F.percentile_approx(f"x{i}", 0.5, 1000).alias(f"c{i}") for i in range(D)]
    centres = written(judged.groupBy(*KEYS).agg(*middle), "mcd-centres")
    off = join_small(judged, centres, KEYS, "x0")
    spread = [F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"c{i}")), 0.5, 1000).alias(f"d{i}") for i in range(D)]
    scales = written(off.groupBy(*KEYS).agg(*spread), "mcd-scales")
    off = join_small(off, scales, KEYS, "x0")
    far = F.lit(0.0)
    for i in range(D):
        far = far + F.pow((F.col(f"x{i}") - F.col(f"c{i}")) / (1.4826 * F.col(f"d{i}") + options.floors[i]), 2)
    # the first start is the plain covariance of the central rows, the second weighs all rows
    # by their distance from the medians
    weights = [F.when(far <= D, 1.0).otherwise(0.0) + F.lit(1e-9), 1.0 / (1.0 + far)]
    estimate = written(_estimates(_moments(off, weights), options.floors), "mcd-estimate")
    for _ in range(options.most_steps):
        near = join_small(judged, estimate, KEYS, "x0").withColumns({f"q{s}": _distance(s) for s in range(STARTS)})
        near = near.select(*KEYS, *[f"x{i}" for i in range(D)], *[f"q{s}" for s in range(STARTS)])
        cuts = near.groupBy(*KEYS).agg(*[F.percentile_approx(f"q{s}", options.half, 2000).alias(f"h{s}") for s in range(STARTS)])
        kept = join_small(near, written(cuts, "mcd-cuts"), KEYS, "x0")
        inside = [F.when(F.col(f"q{s}") <= F.col(f"h{s}"), 1.0).otherwise(0.0) for s in range(STARTS)]
        last, estimate = estimate, written(_estimates(_moments(kept, inside), options.floors, options.consistency), "mcd-estimate")
        if _moved(last, estimate) < options.still:
            break
    return estimate


def quality_rules(documents: DataFrame, options: OutlierOptions = OutlierOptions()) -> DataFrame:
    """(row, uid, statistics, base_failed, distance, kept); ``row`` holds all columns but the text."""
    counted = with_counts(documents).select("row", "uid", F.col("row.lang").alias("_lang"), F.col("row.source").alias("_source"), *COUNTS)
    failed = base_failed()
    counted = written(counted.select("*", failed.alias("base_failed"), *[v.alias(f"x{i}") for i, v in enumerate(vector())]), "rule-counts")
    groups = counted.where(~F.col("base_failed")).groupBy("_lang", "_source").agg(F.count("*").alias("_n"))
    pooled = groups.groupBy(F.col("_lang").alias("_l"), (F.col("_n") >= options.least).alias("_big")).agg(F.sum("_n").alias("_m"))
    alone = groups.join(pooled, F.col("_lang").eqNullSafe(F.col("_l")) & ((F.col("_n") >= options.least) == F.col("_big")))
    # groups too small for an estimate: together with those of the language, else of all languages
    named = F.when(F.col("_big"), F.concat(F.lit("="), F.coalesce(F.concat(F.lit("'"), "_source"), F.lit("-")))).otherwise(F.lit("*"))
    tongue = F.when(F.col("_big") | (F.col("_m") >= options.least), F.concat(F.lit("="), F.coalesce(F.concat(F.lit("'"), "_lang"), F.lit("-")))).otherwise(F.lit("*"))
    table = written(alone.select("_lang", "_source", tongue.alias("g_lang"), named.alias("g_source")), "rule-groups")
    placed = join_small(counted, table, ["_lang", "_source"], "x0")
    judged = placed.where(~F.col("base_failed")).select(*KEYS, *[f"x{i}" for i in range(D)])
    estimate = fit_outliers(written(judged, "rule-vectors"), options)
    sized = judged.groupBy(*KEYS).agg(F.count("*").alias("_members"))
    rated = join_small(placed, estimate, KEYS, "x0")
    rated = join_small(rated, written(sized, "rule-sizes"), KEYS, "x0")
    best = F.when(F.col("det0") <= F.col("det1"), _distance(0)).otherwise(_distance(1))
    distance = F.when(~F.col("base_failed") & (F.col("_members") >= options.least), best)
    return rated.select(
        "row", "uid", *COUNTS, "base_failed", distance.alias("distance"),
        (~F.col("base_failed") & (F.coalesce(distance, F.lit(0.0)) <= options.cutoff)).alias("kept"),
    )


def quality_filter(documents: DataFrame, options: OutlierOptions = OutlierOptions()) -> DataFrame:
    """The rows that are kept, all columns as they are."""
    rated = quality_rules(documents.select("doc_id", "lang", "source", "text"), options)
    rejected = written(rated.where(~F.col("kept")).select(F.col("uid").alias("_uid")).distinct(), "rule-rejected")
    keyed = documents.select(F.struct("*").alias("row"), row_key().alias("_uid"))
    near = F.broadcast(rejected) if rejected.count() <= NEAR_ROWS else rejected
    return keyed.join(near, "_uid", "left_anti").select("row.*")
