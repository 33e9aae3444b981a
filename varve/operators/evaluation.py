"""Metric reports over a long table of predictions.

A prediction table has one row per (row, model) with the observed and the
predicted value, so that one aggregation serves all models and splits.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.functions import errors
from varve.functions.columns import finite_or_null, named
from varve.operators.quantiles import LIMIT, exact_quantiles

METRICS = ["r2", "mae", "mse", "medae", "rmse", "mape"]
_DIRECT = {
    "r2": errors.r_squared,
    "mae": errors.mean_absolute_error,
    "mse": errors.mean_squared_error,
    "rmse": errors.root_mean_squared_error,
    "mape": errors.mean_percentage_error,
}


def long_predictions(
    df: DataFrame, models: dict[str, Column], keep: Sequence[str], y: str = "y_true"
) -> DataFrame:
    """Turn one column per model into rows ``(*keep, model, y_true, y_pred)``.

    A projection with a generator: rows are not shuffled.
    """
    cells = F.array(
        *[F.struct(F.lit(m).alias("model"), p.cast("double").alias("y_pred")) for m, p in models.items()]
    )
    out = df.select(*[named(k) for k in keep], named(y).cast("double").alias("y_true"), F.inline(cells))
    return out.select(*[named(k) for k in keep], "model", "y_true", "y_pred")


def report(
    predictions: DataFrame, by: Sequence[str] = ("model", "split"), metrics: Sequence[str] = METRICS,
    limit: int = LIMIT,
) -> DataFrame:
    """One row per group with the wanted metrics over the ``n`` rows that have both values.

    ``n_missing`` rows lack one of them (NULL or NaN) and take part in no metric.

    All but the median absolute error combine on the map side in one
    aggregation. The median comes from exact quantiles and is joined on the
    group, of which there are a handful.
    """
    if not by:
        whole = predictions.withColumn("whole", F.lit(True))
        return report(whole, ["whole"], metrics, limit).drop("whole")
    by = list(by)
    predictions = _complete_pairs(predictions, by)
    y, p = F.col("y_true"), F.col("y_pred")
    direct = [_DIRECT[m](y, p).alias(m) for m in metrics if m != "medae"]
    out = predictions.groupBy(*[named(b) for b in by]).agg(
        F.count(y).alias("n"), F.count_if(y.isNull()).alias("n_missing"), *direct
    )
    if "medae" in metrics:
        off = predictions.select(*[named(b) for b in by], errors.absolute_error(y, p).alias("off"))
        medians = exact_quantiles(off, ["off"], [0.5], by=by, limit=limit)
        medians = medians.select(*[named(b) for b in by], F.col("value").alias("medae"))
        on = [named(b).eqNullSafe(F.col(f"of{i}")) for i, b in enumerate(by)]
        medians = medians.withColumnsRenamed({b: f"of{i}" for i, b in enumerate(by)})
        out = out.join(medians, on, "left")
    return out.select(*[named(b) for b in by], "n", "n_missing", *metrics)


def _complete_pairs(predictions: DataFrame, by: Sequence[str]) -> DataFrame:
    """The pairs; both values are NULL where one of them is missing."""
    y, p = finite_or_null(F.col("y_true")), finite_or_null(F.col("y_pred"))
    whole = y.isNotNull() & p.isNotNull()
    return predictions.select(
        *[named(b) for b in by], F.when(whole, y).alias("y_true"), F.when(whole, p).alias("y_pred")
    )


def cross_validated_score(predictions: DataFrame, by: Sequence[str] = ("model",), fold: str = "fold") -> DataFrame:
    """Mean over folds of the negated MAE of each fold, unweighted.

    NULL where a prediction is missing: such a model has no score.
    """
    per_fold = _complete_pairs(predictions, [*by, fold]).groupBy(*by, fold).agg(
        F.when(F.every(F.col("y_true").isNotNull()), errors.mean_absolute_error(F.col("y_true"), F.col("y_pred")))
        .alias("mae")
    )
    return per_fold.groupBy(*by).agg(
        F.when(F.count("mae") == F.count(F.lit(1)), -F.avg("mae")).alias("score"), F.count(F.lit(1)).alias("folds")
    )


class ErrorEvaluator(Evaluator, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Evaluator for any metric of the report, MAPE and MedAE included."""

    metric = Param(Params._dummy(), "metric", "one of " + ", ".join(METRICS), TypeConverters.toString)

    @keyword_only
    def __init__(self, *, metric="mae", labelCol="label", predictionCol="prediction"):
        super().__init__()
        self._setDefault(metric="mae")
        self._set(**self._input_kwargs)

    def _evaluate(self, dataset: DataFrame) -> float:
        name = self.getOrDefault(self.metric)
        pairs = dataset.select(
            named(self.getLabelCol()).cast("double").alias("y_true"),
            named(self.getPredictionCol()).cast("double").alias("y_pred"),
        )
        row = report(pairs, by=(), metrics=[name]).first()
        if row is None:
            return math.nan  # no rows, no score
        if row["n_missing"]:
            raise ValueError(f"{row['n_missing']} rows lack the observed or the predicted value")
        return row[name]

    def isLargerBetter(self) -> bool:
        return self.getOrDefault(self.metric) == "r2"
