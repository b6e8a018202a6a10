"""Column functions on scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.0**-52
K1, B = 1.5, 0.75


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def gap(top: Column, reference: Column) -> Column:
    return clamp((top - reference) / (F.abs(top) + F.abs(reference) + EPSILON))


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def relative(score: Column, low: Column, high: Column) -> Column:
    return F.when(low == high, F.lit(0.5)).otherwise(clamp((score - low) / (high - low)))


def distribution(score: Column, mean: Column, deviation: Column, low: Column, high: Column) -> Column:
    flat = (low == high) | deviation.isNull() | (deviation == 0)
    return F.when(flat, F.lit(0.5)).otherwise(clamp((score - (mean - 3 * deviation)) / (6 * deviation)))


def reciprocal_rank(rank: Column) -> Column:
    return 1.0 / (60 + rank)
