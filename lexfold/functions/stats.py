"""Sampling statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-sided normal quantiles by confidence level.
Z = {90: 1.6449, 95: 1.9599, 99: 2.5758}


def sample_size(population: Column, confidence: int = 95, margin: float = 0.05, expected_rate: float = 0.5) -> Column:
    """Documents to draw for a proportion within +-margin, with finite population correction; at most all."""
    if not (0 < margin < 1 and 0 < expected_rate < 1):
        raise ValueError("margin and expected_rate must be between 0 and 1")
    n0 = Z[confidence] ** 2 * expected_rate * (1 - expected_rate) / margin**2
    return F.least(population, F.ceil(F.lit(n0) / (1 + F.lit(n0 - 1) / population)))


def wilson(positives: Column, n: Column, confidence: int = 95) -> tuple[Column, Column, Column]:
    """rate, low, high of the Wilson score interval; zeros when n is 0."""
    z2 = Z[confidence] ** 2
    m = F.when(n > 0, n.cast("double"))
    p = positives / m
    scale = 1 + F.lit(z2) / m
    centre = (p + F.lit(z2) / (2 * m)) / scale
    half = F.lit(math.sqrt(z2)) * F.sqrt(p * (1 - p) / m + F.lit(z2) / (4 * m * m)) / scale
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return zero(p), zero(F.greatest(F.lit(0.0), centre - half)), zero(F.when(n > 0, F.least(F.lit(1.0), centre + half)))


def accepted(defects: Column, n: Column, tolerable: Column, confidence: int = 95) -> Column:
    return (n > 0) & (wilson(defects, n, confidence)[2] <= tolerable)


def wilson_sql(positives: str, n: str, confidence: int = 95) -> tuple[str, str, str]:
    """The same in SQL, for the oracles."""
    z2 = Z[confidence] ** 2
    m = f"nullif(CAST({n} AS DOUBLE), 0)"
    p = f"({positives} / {m})"
    centre = f"(({p} + {z2!r} / (2 * {m})) / (1 + {z2!r} / {m}))"
    half = f"({math.sqrt(z2)!r} * sqrt({p} * (1 - {p}) / {m} + {z2!r} / (4 * {m} * {m})) / (1 + {z2!r} / {m}))"
    return f"coalesce({p}, 0.0)", f"CASE WHEN {n} > 0 THEN greatest(0.0, {centre} - {half}) ELSE 0.0 END", f"CASE WHEN {n} > 0 THEN least(1.0, {centre} + {half}) ELSE 0.0 END"
