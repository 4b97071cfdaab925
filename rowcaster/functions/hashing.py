"""Deterministic pseudo-random columns derived from a row key.

A value depends only on the key and the seed, so a recomputed task returns the same
value wherever it runs. ``rand()`` depends on the partition and is not used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647  # 2^31 - 1


def unit_hash(*keys: Column | str, seed: int = 42) -> Column:
    """Uniform double in [0, 1) from any key columns."""
    h = F.xxhash64(*keys, F.lit(seed))
    return F.shiftrightunsigned(h, 11) * F.lit(2.0**-53)


def arithmetic_unit(key: Column | str, seed: int = 42) -> Column:
    """Uniform double in (0, 1) from a non-negative integer key.

    Uses integer arithmetic only, so any SQL engine can reproduce it.
    """
    k = F.col(key) if isinstance(key, str) else key
    k = k.cast("long")
    low = k % F.lit(PRIME)
    high = ((k - low) / F.lit(PRIME)).cast("long")
    a = (low * 48271 + high * 16807 + F.lit(seed * 7919 + 12345)) % F.lit(PRIME)
    a = a.bitwiseXOR(F.shiftright(a, 15))
    a = (a * 69621 + F.lit(seed)) % F.lit(PRIME)
    a = a.bitwiseXOR(F.shiftright(a, 13))
    a = (a * 39373) % F.lit(PRIME)
    return (a.cast("double") + 0.5) / F.lit(float(PRIME) + 1.0)


def uniform_int(key: Column | str, low: int, high: int, seed: int) -> Column:
    """Uniform long in [low, high)."""
    return F.lit(low) + F.floor(arithmetic_unit(key, seed) * F.lit(high - low))


def normal(key: Column | str, mean: float, std: float, seed: int) -> Column:
    """Normal deviate from two independent uniforms (Box-Muller)."""
    u = arithmetic_unit(key, 2 * seed + 1)
    v = arithmetic_unit(key, 2 * seed + 2)
    z = F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0 * math.pi) * v)
    return F.lit(float(mean)) + F.lit(float(std)) * z


def choice(key: Column | str, values: list, seed: int) -> Column:
    """One of ``values`` with equal probability."""
    i = F.floor(arithmetic_unit(key, seed) * F.lit(len(values))).cast("int")
    return F.element_at(F.array(*[F.lit(v) for v in values]), i + 1)
