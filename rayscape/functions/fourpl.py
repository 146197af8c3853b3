"""The four-parameter logistic curve, as Columns: d + (a - d) * expit(b * (z - c))."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def expit(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def curve(z: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    return d + (a - d) * expit(b * (z - c))


def deriv(z: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    f = expit(b * (z - c))
    return (a - d) * b * f * (F.lit(1.0) - f)


def dderiv(z: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    f = expit(b * (z - c))
    return (a - d) * b * b * f * (F.lit(1.0) - f) * (F.lit(1.0) - F.lit(2.0) * f)


def prob(z: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """The curve, and 0 for a missing value."""
    return F.coalesce(curve(F.nanvl(z, F.lit(None).cast("double")), a, b, c, d), F.lit(0.0))


def predict(z: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.when(prob(z, a, b, c, d) > 0.5, 1).otherwise(0)


def inverse(y: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """Where the curve has the value y; NULL outside its range."""
    p = (y - d) / F.nullif(a - d, F.lit(0.0))
    return F.when((p > 0) & (p < 1), c + F.ln(p / (F.lit(1.0) - p)) / b)


def height_bounds(b: Column, c: Column) -> dict[str, Column]:
    """Lower bound, mid-point and upper bound of a building's height."""
    upper = c + F.lit(3.0) / b
    return {"lower_bound": c, "mid_point": (c + upper) / F.lit(2.0), "upper_bound": upper}
