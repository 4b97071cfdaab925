"""Row-level expressions: clipping, binning, rule scores, captions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bin edges for age, rule thresholds, captions.
AGE_EDGES = (0.0, 30.0, 45.0, 60.0, 120.0)
RISK_THRESHOLDS = {
    "age": 50.0,
    "bmi": 30.0,
    "heart_rate": 85.0,
    "blood_pressure": 140.0,
    "cholesterol": 240.0,
}
RISK_BANDS = ("🔴 HIGH RISK", "🟡 MODERATE RISK", "🟢 POSITIVE", "✅ NEGATIVE")
MALE_TOKENS = ("male", "m", "1")


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    """NaN and NULL both mean missing; keep only NULL."""
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def clip(c: Column | str, low: float, high: float) -> Column:
    """Clamp to [low, high]; NULL and NaN pass through."""
    c = as_col(c)
    return F.when(c.isNull() | F.isnan(c), c).otherwise(
        F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c))
    )


def bin_index(c: Column | str, edges: Sequence[float] = AGE_EDGES) -> Column:
    """Number of edges at or below the value: bin i holds edge[i-1] <= x < edge[i]."""
    c = as_col(c)
    out = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        out = F.when(c < F.lit(float(edges[i])), F.lit(i)).otherwise(out)
    return F.when(c.isNotNull(), out).cast("int")


def logistic(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def above(score: Column | str, threshold: float, strict: bool = False) -> Column:
    """1 where the score reaches the threshold (``strict``: exceeds it), else 0."""
    score = as_col(score)
    hit = score > F.lit(threshold) if strict else score >= F.lit(threshold)
    return hit.cast("int")


def sex_code(c: Column | str, is_string: bool = True) -> Column:
    """1.0 for a male spelling in any case, 0.0 for other text; numbers pass through."""
    c = as_col(c)
    if not is_string:
        return c.cast("double")
    male = F.lower(c).isin(*MALE_TOKENS)
    return F.when(c.isNotNull(), F.when(male, F.lit(1.0)).otherwise(F.lit(0.0)))


def to_number(c: Column | str) -> Column:
    """Text to double; NULL where the text is not a number."""
    return as_col(c).try_cast("double")


def rule_score(thresholds: dict[str | Column, float] | list[tuple[Column, float]]) -> Column:
    """One point for each value above its threshold; a missing value scores nothing."""
    pairs = thresholds.items() if isinstance(thresholds, dict) else thresholds
    total = F.lit(0)
    for c, limit in pairs:
        total = total + F.coalesce((as_col(c) > F.lit(float(limit))).cast("int"), F.lit(0))
    return total


def rule_tier(score: Column | str) -> Column:
    """3, 2, 1 or 0 points."""
    return F.least(F.lit(3), as_col(score))


def draw_in_tier(tier: Column | str, unit: Column, classes: dict[int, Sequence[str]]) -> Column:
    """A class of the row's tier, chosen by a uniform value in [0, 1)."""
    tier = as_col(tier)
    out = F.lit(None).cast("string")
    for level, names in classes.items():
        index = F.floor(unit * F.lit(len(names))).cast("int") + 1
        pick = F.element_at(F.array(*[F.lit(n) for n in names]), index)
        out = F.when(tier == F.lit(level), pick).otherwise(out)
    return out


def first_maximum(scores: dict[str, Column]) -> Column:
    """Name of the largest score; the first one wins a tie."""
    values = F.array(*scores.values())
    names = F.array(*[F.lit(n) for n in scores])
    return F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))


def risk_band(prediction: Column | str, probability: Column | str) -> Column:
    """Band of a positive decision by its probability; a gap in either has none."""
    pred, p = as_col(prediction), as_col(probability).cast("double")
    high, moderate, positive, negative = RISK_BANDS
    return (
        F.when(pred.isNull() | p.isNull() | F.isnan(p), F.lit(None).cast("string"))
        .when(pred != 1, F.lit(negative))
        .when(p >= 0.8, F.lit(high))
        .when(p >= 0.6, F.lit(moderate))
        .otherwise(F.lit(positive))
    )


def percent(p: Column | str) -> Column:
    """Share as text with one decimal."""
    return F.format_string("%.1f%%", as_col(p) * F.lit(100.0))


def display_name(c: Column | str) -> Column:
    return F.translate(as_col(c), "_", " ")


def binary_caption(p1: Column | str) -> Column:
    hit = above(p1, 0.5, strict=True)
    return F.when(hit == 1, F.lit("Disease Detected")).when(hit == 0, F.lit("Healthy"))


def class_caption(k: Column | str) -> Column:
    return F.concat(F.lit("Disease Class "), as_col(k).cast("string"))
