"""Scalar functions of formulas that never fail: what is not finite is zero."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def finite(x: Column) -> Column:
    """x, or 0 where it is null, NaN or infinite; x is computed once."""
    return F.transform(F.array(x), lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v))[0]


def add(a: Column, b: Column) -> Column:
    return finite(a + b)


def sub(a: Column, b: Column) -> Column:
    return finite(a - b)


def mul(a: Column, b: Column) -> Column:
    return finite(a * b)


def div(a: Column, b: Column) -> Column:
    """0 where the divisor is nearer to zero than 1e-8."""
    return finite(F.when(F.abs(b) < 1e-8, 0.0).otherwise(F.try_divide(a, b)))


def neg(a: Column) -> Column:
    return finite(-a)


def absolute(a: Column) -> Column:
    return finite(F.abs(a))


def exp(a: Column) -> Column:
    """1 above an exponent of 10."""
    return finite(F.when(a > 10, 1.0).otherwise(F.exp(a)))


def log(a: Column) -> Column:
    return finite(F.when(a <= 0, 0.0).otherwise(F.ln(a)))


def sqrt(a: Column) -> Column:
    return finite(F.when(a < 0, 0.0).otherwise(F.sqrt(a)))


def greater(a: Column, b: Column) -> Column:
    return finite(F.greatest(a, b))


def lesser(a: Column, b: Column) -> Column:
    return finite(F.least(a, b))


def squashed(a: Column) -> Column:
    return F.tanh(finite(a))


def fmt_seconds(s: float) -> str:
    """A duration for people: 45.0s, 3m 05s, 2h 03m 04s."""
    if s < 60:
        return f"{s:.1f}s"
    minutes, seconds = divmod(int(s), 60)
    hours, minutes = divmod(minutes, 60)
    return f"{hours}h {minutes:02d}m {seconds:02d}s" if hours else f"{minutes}m {seconds:02d}s"
