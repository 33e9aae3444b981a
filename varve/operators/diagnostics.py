"""Binned and ranked views of a prediction table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.functions import errors
from varve.functions.columns import named
from varve.functions.labels import interval_labels
from varve.operators.evaluation import report
from varve.operators.quantiles import exact_quantiles

# Numbers of bins and the margin of a parity diagram.
DECILES = 10
RANGE_BINS = 5
LOWER_MARGIN, UPPER_MARGIN = 0.97, 1.03


def quantile_edges(
    df: DataFrame, column: str, bins: int, by: Sequence[str] = (), decimals: int | None = None
) -> DataFrame:
    """Rows ``(*by, edges, labels)``: distinct quantile edges, ascending.

    ``bins + 1`` numbers per group travel to the driver to be labelled; a
    group with fewer than two distinct edges has no bins and is left out.
    """
    by = list(by)
    found = exact_quantiles(df, [column], [i / bins for i in range(bins + 1)], by=by).collect()
    groups: dict[tuple, set[float]] = {}
    for r in found:
        if r["value"] is not None:
            value = r["value"] if decimals is None else round(r["value"], decimals)
            groups.setdefault(tuple(r[b] for b in by), set()).add(value)
    rows = [(*g, sorted(e), interval_labels(sorted(e))) for g, e in groups.items() if len(e) > 1]
    schema = T.StructType([
        *[df.schema[b] for b in by],
        T.StructField("edges", T.ArrayType(T.DoubleType())),
        T.StructField("labels", T.ArrayType(T.StringType())),
    ])
    return df.sparkSession.createDataFrame(rows, schema)


def bin_index(value: Column, edges: Column, bins: int) -> Column:
    """Zero-based right-closed bin: the number of inner edges below the value.

    The lowest value belongs to the first bin. A chain of comparisons stays in
    generated code, where an array function with a lambda would not.
    """
    last = F.size(edges) - 1
    passed = [
        F.when((F.lit(i) < last) & (value > F.get(edges, F.lit(i))), 1).otherwise(0) for i in range(1, bins)
    ]
    return sum(passed, F.lit(0))


def with_quantile_bins(
    df: DataFrame, column: str, bins: int, by: Sequence[str] = (), decimals: int | None = None
) -> DataFrame:
    """Add ``bin`` and ``label``; both are NULL where a group has no bins."""
    if not by:
        whole = df.withColumn("whole", F.lit(True))
        return with_quantile_bins(whole, column, bins, ["whole"], decimals).drop("whole")
    by = list(by)
    edges = quantile_edges(df, column, bins, by, decimals)  # one short row per group
    joined = df.join(edges, by, "left")
    index = F.when(F.col("edges").isNotNull() & named(column).isNotNull(),
                   bin_index(named(column), F.col("edges"), bins))
    return (
        joined.withColumn("bin", index)
        .withColumn("label", F.get("labels", F.col("bin")))
        .drop("edges", "labels")
    )


def calibration(predictions: DataFrame, bins: int = DECILES, decimals: int | None = None) -> DataFrame:
    """Mean predicted and mean observed value per predicted-quantile bin."""
    return (
        with_quantile_bins(predictions, "y_pred", bins, ["model"], decimals)
        .where(F.col("bin").isNotNull())
        .groupBy("model", "bin")
        .agg(F.avg("y_pred").alias("mean_pred"), F.avg("y_true").alias("mean_true"))
        .orderBy("model", "bin")
    )


def error_by_range(predictions: DataFrame, bins: int = RANGE_BINS, decimals: int | None = None) -> DataFrame:
    """MAPE per quantile bin of the observed value, for the bins that occur."""
    return (
        with_quantile_bins(predictions, "y_true", bins, ["model"], decimals)
        .where(F.col("bin").isNotNull())
        .groupBy("model", "bin", "label")
        .agg(errors.mean_percentage_error(F.col("y_true"), F.col("y_pred")).alias("mape"))
        .orderBy("model", "bin")
    )


def parity_table(predictions: DataFrame) -> DataFrame:
    """Observed against predicted value, with the R² of the model on each row."""
    r2 = report(predictions, by=["model"], metrics=["r2"]).select("model", "r2")
    return predictions.join(F.broadcast(r2), "model")  # one row per model


def axis_limits(predictions: DataFrame) -> DataFrame:
    """Range of the parity diagram per model, and over all models together."""
    both = lambda low, high: [
        (F.least(F.min("y_true"), F.min("y_pred")) * LOWER_MARGIN).alias(low),
        (F.greatest(F.max("y_true"), F.max("y_pred")) * UPPER_MARGIN).alias(high),
    ]
    per_model = predictions.groupBy("model").agg(*both("lower", "upper"))
    return per_model.unionByName(
        per_model.agg(
            F.lit("(all)").alias("model"), F.min("lower").alias("lower"), F.max("upper").alias("upper")
        )
    )


def calibration_limits(calibrated: DataFrame) -> DataFrame:
    """The same for a calibration table, whose points are bin means."""
    points = calibrated.select("model", F.col("mean_true").alias("y_true"), F.col("mean_pred").alias("y_pred"))
    return axis_limits(points)


def rank_by_error(predictions: DataFrame) -> DataFrame:
    """Models by ascending MAPE. The window sees one row per model."""
    mapes = report(predictions, by=["model"], metrics=["mape"]).select("model", "mape")
    return mapes.withColumn("rank", F.row_number().over(Window.orderBy("mape", "model")))
