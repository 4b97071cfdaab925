"""Rule-based rows. Every value is a function of the row key and the seed.

``keys`` may be any table with a non-negative integer key; ``range_keys`` makes one.
Distributions match the described ones; the draws are our own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import arithmetic_unit, choice, normal, uniform_int
from ..functions.scalar import (
    RISK_THRESHOLDS,
    clip,
    draw_in_tier,
    first_maximum,
    logistic,
    rule_score,
    rule_tier,
)

# Classes open to each tier of the rule score.
TIER_CLASSES = {
    3: ["Heart_Disease", "Hypertension", "Diabetes"],
    2: ["Diabetes", "Hypertension", "Arthritis"],
    1: ["Asthma", "Arthritis"],
    0: ["Healthy"],
}

# Mean, deviation, lower and upper bound per measurement.
MULTICLASS_MEASURES = {
    "bmi": (27, 5, 15, 50),
    "heart_rate": (75, 12, 50, 120),
    "blood_pressure": (120, 15, 80, 180),
    "cholesterol": (200, 40, 120, 350),
}
TIERED_MEASURES = {
    "age": (45, 15, 18, 80),
    "bmi": (25, 5, 15, 45),
    "heart_rate": (72, 12, 50, 120),
    "blood_pressure": (120, 20, 90, 180),
    "cholesterol": (200, 40, 150, 350),
}

# Weight and centre per measurement.
OUTCOME_WEIGHTS = {"age": (0.04, 50), "bmi": (0.1, 25)}
LATENT_WEIGHTS = {
    "Diabetes": {"bmi": (0.05, 25), "age": (0.03, 40)},
    "Hypertension": {"blood_pressure": (0.08, 120), "age": (0.04, 50)},
    "Heart_Disease": {"cholesterol": (0.06, 200), "age": (0.05, 55), "bmi": (0.03, 25)},
    "Asthma": {"age": (-0.02, 0)},
    "Arthritis": {"age": (0.08, 45)},
    "Healthy": {},
}

# Mean and deviation of the noise per class.
LATENT_NOISE = {
    "Diabetes": (0, 2),
    "Hypertension": (0, 2),
    "Heart_Disease": (0, 2),
    "Asthma": (0, 3),
    "Arthritis": (0, 2),
    "Healthy": (-3, 1),
}


def range_keys(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "row_id")


def weighted_score(weights: dict[str, tuple[float, float]], noise: Column) -> Column:
    """Sum of weight * (measurement - centre), plus noise."""
    total = noise
    for c, (weight, centre) in weights.items():
        total = total + F.lit(float(weight)) * (F.col(c) - F.lit(float(centre)))
    return total


def measures(key: str, table: dict[str, tuple], seed: int) -> list[Column]:
    """Normal deviates clamped to their bounds."""
    return [
        clip(normal(key, mean, std, seed + i), low, high).alias(c)
        for i, (c, (mean, std, low, high)) in enumerate(table.items())
    ]


def binary_rows(keys: DataFrame, key: str = "row_id", seed: int = 42) -> DataFrame:
    """Two classes from a logistic rule, with two columns that must not reach a model."""
    base = keys.select(
        F.col(key),
        uniform_int(key, 20, 80, seed + 1).alias("age"),
        choice(key, ["M", "F"], seed + 2).alias("gender"),
        normal(key, 28, 4, seed + 3).alias("bmi"),
        normal(key, 75, 8, seed + 4).alias("heart_rate"),
        choice(key, ["none", "short", "long"], seed + 5).alias("discharge_notes"),
        normal(key, 1000, 200, seed + 6).alias("bill_amount"),
    )
    p = logistic(weighted_score(OUTCOME_WEIGHTS, normal(key, 0, 1, seed + 7)))
    return base.withColumn("outcome", (p > 0.5).cast("int"))


def multiclass_rows(keys: DataFrame, key: str = "row_id", seed: int = 42) -> DataFrame:
    """Six classes: the largest noisy risk score names the row."""
    base = keys.select(
        F.col(key),
        uniform_int(key, 18, 85, seed + 1).alias("age"),
        choice(key, ["M", "F"], seed + 2).alias("gender"),
        *measures(key, MULTICLASS_MEASURES, seed + 3),
    )
    scores = {
        name: weighted_score(LATENT_WEIGHTS[name], normal(key, mean, std, seed + 10 + i))
        for i, (name, (mean, std)) in enumerate(LATENT_NOISE.items())
    }
    return base.withColumn("prognosis", first_maximum(scores))


def tiered_rows(keys: DataFrame, key: str = "row_id", seed: int = 42) -> DataFrame:
    """Class drawn among those open to the row's rule score."""
    base = keys.select(
        F.col(key),
        choice(key, [0, 1], seed + 1).alias("gender"),
        *measures(key, TIERED_MEASURES, seed + 2),
    )
    tier = rule_tier(rule_score(RISK_THRESHOLDS))
    return base.withColumn("prognosis", draw_in_tier(tier, arithmetic_unit(key, seed + 7), TIER_CLASSES))


def label_distribution(df: DataFrame, label: str = "prognosis") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n_rows"))
