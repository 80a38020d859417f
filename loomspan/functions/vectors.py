"""Vector arithmetic as column expressions. Vectors are arrays of floats; sums are in doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.config import ZERO_NORM


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """The unit vector; NULL for a zero vector."""
    n = norm(v)
    return F.when(n >= ZERO_NORM, F.transform(doubles(v), lambda x: x / n))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - dot, for unit vectors."""
    return F.lit(1.0) - dot(a, b)


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def vector_problem(v: Column, dim: int) -> Column:
    """DimensionMismatch before ZeroVector; NULL if the vector can be stored."""
    wrong = v.isNull() | (F.size(v) != dim)
    return F.when(wrong, "DimensionMismatch").when(norm(v) < ZERO_NORM, "ZeroVector")


def valid_vectors(rows: DataFrame, column: str, dim: int, strict: bool = True) -> DataFrame:
    """rows with unit vectors. strict: a bad vector raises; else such rows are left out."""
    problem = vector_problem(F.col(column), dim)
    if strict:
        checked = F.when(problem.isNull(), F.col(column)).otherwise(F.raise_error(problem))
        return rows.withColumn(column, normalize(checked))
    return rows.where(problem.isNull()).withColumn(column, normalize(F.col(column)))
