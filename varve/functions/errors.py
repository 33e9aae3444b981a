"""Error metrics as aggregate expressions over observed and predicted values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: smallest denominator of a relative error (double epsilon).
RELATIVE_FLOOR = 2.220446049250313e-16


def absolute_error(y: Column, p: Column) -> Column:
    return F.abs(y - p)


def mean_absolute_error(y: Column, p: Column) -> Column:
    return F.avg(absolute_error(y, p))


def mean_squared_error(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def root_mean_squared_error(y: Column, p: Column) -> Column:
    return F.sqrt(mean_squared_error(y, p))


def mean_percentage_error(y: Column, p: Column) -> Column:
    """Mean absolute error relative to the observed value, in percent."""
    floor = F.greatest(F.abs(y), F.lit(RELATIVE_FLOOR))
    return F.avg(absolute_error(y, p) / floor) * 100.0


def r_squared(y: Column, p: Column) -> Column:
    """Share of variance explained: 1 - MSE / variance of the observed values.

    This is not ``regr_r2``, which is the squared correlation. A constant
    observed value gives 1 for perfect predictions and else 0; fewer than two
    rows give NULL.
    """
    mse = mean_squared_error(y, p)
    return (
        F.when(F.count(y) < 2, F.lit(None).cast("double"))
        .when(F.min(y) == F.max(y), F.when(mse == 0, 1.0).otherwise(0.0))
        .otherwise(1.0 - mse / F.var_pop(y))
    )
