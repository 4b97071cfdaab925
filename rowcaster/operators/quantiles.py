"""Exact order statistics without sorting or collecting a whole column.

``exact_medians`` narrows a bracket around the wanted ranks. A sample of the rows inside
the bracket suggests a narrower one; a counting pass proves where the ranks lie, so the
sample affects speed only. Counting passes are compiled aggregates without a row shuffle
and serve all columns together. Values are collected only once the counted inside is at
most ``COLLECT_LIMIT``.

``order_values`` serves many ranks of one column: narrow buckets around the ranks are
counted, and only rows of those buckets are shuffled, already merged by value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLLECT_LIMIT = 200_000
SAMPLE_ROWS = 100_000
SAMPLE_SHARE = 0.001  # of very large brackets
RANK_ACCURACY = 20_000
SEARCHES_PER_PASS = 512
INF = float("inf")


@dataclass
class _Search:
    """One median: its column in the projected table and the open bracket (low, high)."""

    key: str
    column: str
    ranks: list[int]
    low: float = -INF
    high: float = INF
    before: int = 0  # values at or below ``low``
    inside: int = 0
    found: dict[int, float] = field(default_factory=dict)
    trial: tuple[float, float] | None = None
    doubt: float = 1.0  # widens the next trial after a miss

    @property
    def open_ranks(self) -> list[int]:
        return [r for r in self.ranks if r not in self.found]

    def within(self, low: float, high: float) -> str:
        return f"CASE WHEN {self.column} > {_number(low)} AND {self.column} < {_number(high)} THEN {self.column} END"


@dataclass
class Medians:
    """Medians by key and, if asked for, (count, mean, population variance) by key."""

    values: dict[str, float | None]
    moments: dict[str, tuple]
    counted: dict[str, int]


def _number(x: float) -> str:
    return f"double('{x!r}')"


def _aggregate(df: DataFrame, columns: list[str]) -> dict:
    """One pass; a wide list is cut so that buffers stay bounded."""
    out: dict = {}
    for start in range(0, len(columns), 4 * SEARCHES_PER_PASS):
        part = [F.expr(c) for c in columns[start : start + 4 * SEARCHES_PER_PASS]]
        out |= df.agg(*part).first().asDict()
    return out


def _suggest(df: DataFrame, searches: list[_Search], seed: int) -> None:
    """Trial brackets from a sample of the rows: the ranks, with eight deviations of slack."""
    share = min(1.0, max(SAMPLE_SHARE, max(SAMPLE_ROWS / s.inside for s in searches)))
    sampled = df if share >= 1.0 else df.sample(withReplacement=False, fraction=share, seed=seed)
    columns = []
    for i, s in enumerate(searches):
        sampling = 4.0 / math.sqrt(share * s.inside) if share < 1.0 else 0.0
        slack = s.doubt * (sampling + 2.0 / RANK_ACCURACY)
        places = [(r - s.before) / s.inside for r in s.open_ranks]
        low, high = places[0] - slack, places[-1] + slack
        levels = f"array({max(0.0, low)!r}D, {min(1.0, high)!r}D)"
        columns.append(f"percentile_approx({s.within(s.low, s.high)}, {levels}, {RANK_ACCURACY}) AS t_{i}")
    row = _aggregate(sampled, columns)
    for i, s in enumerate(searches):
        if row[f"t_{i}"]:
            s.trial = tuple(float(v) for v in row[f"t_{i}"])
        else:
            s.trial, s.doubt = None, 2.0 * s.doubt


def _prove(df: DataFrame, searches: list[_Search]) -> None:
    """Count around the trial brackets; adopt those that hold the ranks."""
    columns = []
    for i, s in enumerate(searches):
        low, high = s.trial
        columns += [
            f"count_if({s.column} < {_number(low)}) AS below_{i}",
            f"count_if({s.column} = {_number(low)}) AS low_{i}",
            f"count({s.within(low, high)}) AS mid_{i}",
            f"count_if({s.column} = {_number(high)}) AS high_{i}",
        ]
    row = _aggregate(df, columns)
    for i, s in enumerate(searches):
        low, high = s.trial
        start, at_low, mid = row[f"below_{i}"], row[f"low_{i}"], row[f"mid_{i}"]
        at_high = row[f"high_{i}"] if high > low else 0
        end = start + at_low + mid + at_high
        if any(r < start or r >= end for r in s.open_ranks):
            s.doubt *= 2.0
            continue
        for r in s.open_ranks:
            if r < start + at_low:
                s.found[r] = low
            elif r >= start + at_low + mid:
                s.found[r] = high
        s.low, s.high, s.before, s.inside, s.doubt = low, high, start + at_low, mid, 1.0


def _collect(df: DataFrame, searches: list[_Search]) -> None:
    """Read the open ranks from the few values left; 16 lists at a time share a task's memory."""
    pending = [(s, r) for s in searches for r in s.open_ranks]
    for start in range(0, len(pending), 16):
        part = pending[start : start + 16]
        row = _aggregate(
            df,
            [
                f"element_at(sort_array(collect_list({s.within(s.low, s.high)})), {r - s.before + 1}) AS v_{i}"
                for i, (s, r) in enumerate(part)
            ],
        )
        for i, (s, r) in enumerate(part):
            s.found[r] = row[f"v_{i}"]


def exact_medians(
    df: DataFrame,
    values: dict[str, Column],
    moments: bool = False,
    conditions: dict[str, Column] | None = None,
    seed: int = 42,
) -> Medians:
    """Median of every expression (NULL skipped, mean of the middle two).

    Expressions are projected once, so that every aggregate reads plain columns. The first
    pass also yields moments, and counts of ``conditions``.
    """
    conditions = conditions or {}
    table = df.select(
        *[v.cast("double").alias(f"x_{i}") for i, v in enumerate(values.values())],
        *[c.alias(f"c_{i}") for i, c in enumerate(conditions.values())],
    )
    columns = [f"count_if(c_{i}) AS counted_{i}" for i in range(len(conditions))]
    for i in range(len(values)):
        columns += [
            f"count(x_{i}) AS n_{i}",
            f"count_if(x_{i} = {_number(-INF)}) AS least_{i}",
            f"count_if(x_{i} = {_number(INF)}) AS most_{i}",
        ]
        if moments:
            columns += [f"avg(x_{i}) AS mean_{i}", f"var_pop(x_{i}) AS var_{i}"]
    first = _aggregate(table, columns) if columns else {}

    searches = []
    for i, k in enumerate(values):
        n, least, most = first[f"n_{i}"], first[f"least_{i}"], first[f"most_{i}"]
        s = _Search(k, f"x_{i}", sorted({(n - 1) // 2, n // 2}) if n else [])
        s.before, s.inside = least, n - least - most
        s.found = {r: -INF if r < least else INF for r in s.ranks if r < least or r >= n - most}
        searches.append(s)
    while True:
        active = [s for s in searches if s.open_ranks and s.inside > COLLECT_LIMIT]
        if not active:
            break
        for start in range(0, len(active), SEARCHES_PER_PASS):
            part = active[start : start + SEARCHES_PER_PASS]
            _suggest(table, part, seed)
            _prove(table, [s for s in part if s.trial is not None])
        seed += 1
    _collect(table, searches)
    return Medians(
        {s.key: (sum(s.found[r] for r in s.ranks) / len(s.ranks) if s.ranks else None) for s in searches},
        {k: (first[f"n_{i}"], first[f"mean_{i}"], first[f"var_{i}"]) for i, k in enumerate(values)} if moments else {},
        {k: first[f"counted_{i}"] for i, k in enumerate(conditions)},
    )


SAMPLED = 100_000  # values that splits are chosen from


def count_and_splits(df: DataFrame, column: str, levels: Sequence[float]) -> tuple[int, list[float]]:
    """Non-null values, and sorted distinct quantiles of a bounded sample of them.

    A plain count and a sampling scan; splits only deal the work, any will do.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    n = values.count()
    if n == 0:
        return 0, []
    drawn = sorted(r["v"] for r in values.sample(min(1.0, SAMPLED / n), seed=1).collect()) or [0.0]
    return n, sorted({drawn[min(len(drawn) - 1, int(q * len(drawn)))] for q in levels})


def with_bucket(df: DataFrame, column: str, splits: Sequence[float], out: str) -> DataFrame:
    """Index of the half-open interval that holds the value (binary search in the JVM)."""
    inner = [s for s in splits if -INF < s < INF]
    edges = [-INF, *(inner or [0.0]), INF]
    return Bucketizer(splits=edges, inputCol=column, outputCol=out).transform(df)


def order_values(
    df: DataFrame, column: str, ranks: Sequence[int], splits: Sequence[float]
) -> dict[int, float]:
    """Values at 0-based ``ranks`` of a column; any ``splits`` give the same result.

    Splits close to the ranks keep the rows of the buckets in between out of the shuffle.
    """
    if not ranks:
        return {}
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    bucketed = with_bucket(values, "v", splits, "b")
    totals = {r["b"]: r["c"] for r in bucketed.groupBy("b").agg(F.count("*").alias("c")).collect()}

    wanted, before, pos = [], 0, 0
    ordered = sorted(set(ranks))
    for b in sorted(totals):
        while pos < len(ordered) and ordered[pos] < before + totals[b]:
            wanted.append((float(b), ordered[pos] - before, ordered[pos]))
            pos += 1
        before += totals[b]
    targets = df.sparkSession.createDataFrame(wanted, "b double, local_rank long, rank long")
    needed = sorted({w[0] for w in wanted})
    running = Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    merged = (
        bucketed.where(F.col("b").isin(needed))
        .groupBy("b", "v")
        .agg(F.count("*").alias("c"))
        .withColumn("upto", F.sum("c").over(running))
    )
    hits = (
        merged.join(F.broadcast(targets), "b")  # one row per requested rank
        .where((F.col("local_rank") < F.col("upto")) & (F.col("local_rank") >= F.col("upto") - F.col("c")))
        .select("rank", "v")
    )
    return {r["rank"]: r["v"] for r in hits.collect()}


def linear_quantiles(df: DataFrame, column: str, levels: Sequence[float]) -> list[float]:
    """Quantiles with linear interpolation between neighbouring order statistics."""
    slack = 4.0 / SAMPLED**0.5
    around = sorted({min(1.0, max(0.0, q + d)) for q in levels for d in (-slack, slack)})
    n, splits = count_and_splits(df, column, around)
    if n == 0:
        return []
    places = [q * (n - 1) for q in levels]
    ranks = {r for p in places for r in (math.floor(p), min(math.floor(p) + 1, n - 1))}
    values = order_values(df, column, sorted(ranks), splits)
    out = []
    for p in places:
        a, b = values[math.floor(p)], values[min(math.floor(p) + 1, n - 1)]
        t = p - math.floor(p)
        out.append(b - (b - a) * (1.0 - t) if t >= 0.5 else a + (b - a) * t)
    return out
