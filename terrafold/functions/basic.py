"""Numeric coercion with one notion of missing: null, NaN and unreadable text are alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def as_column(value) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.col(value)
    return F.lit(value)


def number(value) -> Column:
    """Double value, null for NaN or text that is not a number."""
    x = as_column(value).try_cast("double")
    return F.when(~F.isnan(x), x)


def finite(value) -> Column:
    """Double value, null unless finite. NaN sorts above infinity in Spark, so one test is enough."""
    x = as_column(value).try_cast("double")
    return F.when(F.abs(x) < F.lit(INFINITY), x)


def is_finite(value) -> Column:
    return finite(value).isNotNull()


def is_missing(value, data_type: str = "double") -> Column:
    """Null or NaN."""
    x = as_column(value)
    if data_type in ("double", "float"):
        return x.isNull() | F.isnan(x)
    return x.isNull()


def between(x: Column, low: float | None, high: float | None) -> Column:
    """Inclusive range test with one-sided bounds."""
    test = F.lit(True)
    if low is not None:
        test = test & (x >= F.lit(float(low)))
    if high is not None:
        test = test & (x <= F.lit(float(high)))
    return test


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def flag_list(*pairs: tuple[Column, str]) -> Column:
    """Ordered array of the names whose condition holds."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in pairs]))
