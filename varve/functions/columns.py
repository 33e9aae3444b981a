"""Column references by exact name, and small type questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def named(name: str) -> Column:
    """Reference a column literally, whatever symbols its name contains."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def finite_or_null(value: Column) -> Column:
    """Treat NaN as missing, like NULL."""
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def to_number(value: Column) -> Column:
    """Numeric reading of any column; text that is no number becomes NULL."""
    return value.try_cast("double")
