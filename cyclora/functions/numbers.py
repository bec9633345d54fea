"""Scores, distances and error terms, as column expressions."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def density(nodes: Column, edges: Column) -> Column:
    return F.when(nodes > 1, edges / (nodes * (nodes - 1))).otherwise(0.0)


def average_degree(nodes: Column, edges: Column) -> Column:
    return F.when(nodes > 0, 2 * edges / nodes).otherwise(0.0)


def ratio_error(a: Column, sa: Column, b: Column, sb: Column) -> Column:
    """The first-order error of a / b."""
    return F.when((a != 0) & (b != 0), F.abs(a / b) * F.sqrt(F.pow(sa / a, 2) + F.pow(sb / b, 2)))


def candidate_score(efficiency: Column, early: Column, conserved: Column, default: float = 0.5) -> Column:
    return efficiency * (1 - early) * F.coalesce(conserved, F.lit(default))


def tier(mismatches: Column, limit: int = 2) -> Column:
    return F.when(mismatches < limit, "HIGH").otherwise("MEDIUM")


def ordinal(c: Column, scores: dict[str, float], default: float) -> Column:
    out = None
    for k, v in scores.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(default)


def geometric_sizes(n: int, steps: int = 100) -> list[int]:
    """Whole sizes from 1 to n in even ratios, each once."""
    if n < 1:
        return []
    if n == 1 or steps < 2:
        return [1] if n == 1 else [1, n]
    return sorted({int(round(n ** (i / (steps - 1)), 9)) for i in range(steps)})


TWO_PI = 2 * pi
