"""Row and column cleaning, and the outlier fence on the target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.functions.columns import finite_or_null, named, numeric_columns, to_number
from varve.operators.quantiles import quantile_table

# Composition columns of the fluid tables this engine was made for.
COMPOSITION = ["N2 (mol%)", "Co2", "H2S", "C1", "C2", "C3", "C4", "C5", "C6", "C7+"]
# Fixed value: fence width in interquartile ranges.
WHISKER = 1.5


def drop_null_rows(df: DataFrame) -> DataFrame:
    """Keep rows without NULL or NaN in any column."""
    return df.na.drop("any")


def distinct_rows(df: DataFrame) -> DataFrame:
    """Distinct rows over all columns; duplicates combine before the shuffle."""
    return df.dropDuplicates()


def clean_table(df: DataFrame, reference: str = "ref") -> DataFrame:
    """Drop incomplete rows, then duplicates, then the reference column.

    The order matters: rows that differ only in the reference both survive.
    """
    return distinct_rows(drop_null_rows(df)).drop(named(reference))


def fence(df: DataFrame, column: str, whisker: float = WHISKER) -> tuple[float, float]:
    """Ends of [Q1 - k IQR, Q3 + k IQR] from exact quartiles."""
    q1, q3 = quantile_table(df, [column], [0.25, 0.75])[column]
    if q1 is None or q3 is None:
        raise ValueError(f"no value in {column!r} to take a fence from")
    return q1 - whisker * (q3 - q1), q3 + whisker * (q3 - q1)


def within_fence(
    df: DataFrame, column: str, whisker: float = WHISKER, fit_on: Column | None = None
) -> DataFrame:
    """Rows whose value lies inside the fence, both ends included.

    The two ends are plain numbers in the plan, so the filter reaches the
    parquet scan. ``fit_on`` restricts the rows that define the fence (say, to
    the training rows); by default the whole table does.
    """
    lo, hi = fence(df if fit_on is None else df.where(fit_on), column, whisker)
    return df.where(named(column).between(lo, hi))


def feature_columns(df: DataFrame, target: str, keys: Sequence[str] = ()) -> list[str]:
    """All columns but the target and the keys; each must be numeric."""
    features = [c for c in df.columns if c != target and c not in keys]
    wrong = sorted(set(features) - set(numeric_columns(df)))
    if wrong:
        raise TypeError(f"features must be numeric: {wrong}")
    return features


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Read the columns as numbers; what is no number becomes NULL."""
    return df.withColumns({c: to_number(named(c)) for c in columns})


def normalise_composition(df: DataFrame, columns: Sequence[str], total: float = 100.0) -> DataFrame:
    """Scale the parts of each row to a fixed sum; an all-zero row gives NULL.

    A missing part counts as nothing in the sum and stays missing.
    """
    parts = {c: finite_or_null(named(c)) for c in columns}
    whole = sum((F.coalesce(p, F.lit(0.0)) for p in parts.values()), F.lit(0.0))
    whole = F.nullif(whole, F.lit(0.0))
    return df.withColumns({c: p / whole * total for c, p in parts.items()})


class _FenceParams(HasInputCols):
    whisker = Param(Params._dummy(), "whisker", "fence width in IQRs", TypeConverters.toFloat)
    normalise = Param(
        Params._dummy(), "normalise", "scale the named columns to a sum of 100", TypeConverters.toBoolean
    )

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(whisker=WHISKER, normalise=True)


class FenceClipper(Estimator, _FenceParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learn a fence per column and clip values to it.

    Without ``inputCols`` all numeric columns are clipped and no row is scaled
    to a fixed sum; with them the clipped parts are scaled when ``normalise``.
    """

    @keyword_only
    def __init__(self, *, inputCols=None, whisker=WHISKER, normalise=True):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "FenceClipperModel":
        chosen = self.isSet(self.inputCols)
        columns = [c for c in self.getInputCols() if c in dataset.columns] if chosen else numeric_columns(dataset)
        whisker = self.getOrDefault(self.whisker)
        quartiles = quantile_table(coerce_numeric(dataset, columns), columns, [0.25, 0.75])
        # A column without a single number has no fence; its values pass as they are.
        quartiles = {c: q for c, q in quartiles.items() if None not in q}
        model = FenceClipperModel()
        return model._set(
            inputCols=list(quartiles),
            lower=[a - whisker * (b - a) for a, b in quartiles.values()],
            upper=[b + whisker * (b - a) for a, b in quartiles.values()],
            parts=columns if chosen and self.getOrDefault(self.normalise) else [],
        )


class FenceClipperModel(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    lower = Param(Params._dummy(), "lower", "lower fence per column", TypeConverters.toListFloat)
    upper = Param(Params._dummy(), "upper", "upper fence per column", TypeConverters.toListFloat)
    parts = Param(Params._dummy(), "parts", "columns scaled to a sum of 100", TypeConverters.toListString)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        bounds = zip(self.getInputCols(), self.getOrDefault(self.lower), self.getOrDefault(self.upper))
        clipped = {}
        for c, lo, hi in bounds:
            if c in dataset.columns:
                v = finite_or_null(to_number(named(c)))
                # greatest/least skip NULL, so a missing value must be kept missing.
                clipped[c] = F.when(v.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), v)))
        out = dataset.withColumns(clipped) if clipped else dataset
        parts = [c for c in self.getOrDefault(self.parts) if c in dataset.columns]
        return normalise_composition(out, parts) if parts else out
