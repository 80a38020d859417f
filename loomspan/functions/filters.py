"""Typed conditions on payload columns. A missing value fails every condition."""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _kind(value) -> str:
    return "bool" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"


def _column_kind(rows: DataFrame, key: str) -> str:
    kind = rows.schema[key].dataType
    return "bool" if isinstance(kind, T.BooleanType) else "number" if isinstance(kind, T.NumericType) else "string"


@dataclass(frozen=True)
class Equals:
    key: str
    value: str | float | bool

    def column(self, rows: DataFrame) -> Column:
        same = self.key in rows.columns and _column_kind(rows, self.key) == _kind(self.value)
        return F.col(self.key) == F.lit(self.value) if same else F.lit(False)


@dataclass(frozen=True)
class _Numeric:
    key: str

    def usable(self, rows: DataFrame) -> bool:
        return self.key in rows.columns and _column_kind(rows, self.key) == "number"


@dataclass(frozen=True)
class AtLeast(_Numeric):
    least: float

    def column(self, rows: DataFrame) -> Column:
        return F.col(self.key) >= self.least if self.usable(rows) else F.lit(False)


@dataclass(frozen=True)
class AtMost(_Numeric):
    most: float

    def column(self, rows: DataFrame) -> Column:
        return F.col(self.key) <= self.most if self.usable(rows) else F.lit(False)


@dataclass(frozen=True)
class Between(_Numeric):
    least: float
    most: float

    def column(self, rows: DataFrame) -> Column:
        return F.col(self.key).between(self.least, self.most) if self.usable(rows) else F.lit(False)


def matching(rows: DataFrame, conditions=()) -> DataFrame:
    """Rows that meet all conditions; with none, all rows."""
    tests = [c.column(rows) for c in conditions]
    return rows.where(reduce(operator.and_, tests)) if tests else rows


def page_range(least: float | None, most: float | None, key: str = "page") -> list:
    """Both bounds make one range, a single bound a one-sided condition, none nothing."""
    if least is not None and most is not None:
        return [Between(key, least, most)]
    return [AtLeast(key, least)] if least is not None else [AtMost(key, most)] if most is not None else []
