"""Regression tables derived from the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.functions.hashing import hash32
from varve.operators.evaluation import long_predictions
from varve.operators.splitting import fold_index, split_label
from varve.session import materialise
from varve.sources.tables import read_table

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TARGET = "target"
KEY = "row_key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def net_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the price after discount and tax as the target.

    The key takes in the price, because two lines may share their numbers.
    """
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws(":", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", cents).alias(KEY),
        *FEATURES,
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias(TARGET),
    )


def labelled_net_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net prices with their split and their fold."""
    key = F.col(KEY)
    return net_price(spark, sf_dir).withColumns({"split": split_label(key), "fold": fold_index(key)})


def training_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a written table in folders per fold, for flows with many fits.

    A fit that leaves out a fold, and the scoring of that fold, read only the
    folders they need.
    """
    return materialise(labelled_net_price(spark, sf_dir), partition_by="fold")


def closed_forms() -> dict:
    """Predictors with a formula instead of a fit, each wrong in its own way."""
    price, discount, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    return {
        "list": price,
        "disc": price * (1 - discount),
        "tax": price * (1 + tax),
        "flat": price * 0.95 * 1.04,
        "const": F.lit(50000.0),
        "exact": F.col(TARGET),
    }


def closed_form_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled_net_price(spark, sf_dir)
    return long_predictions(rows, closed_forms(), [KEY, "split", "fold"], TARGET)


def gappy_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of which some are NULL and some NaN, and observed values that are missing."""
    rows = closed_form_predictions(spark, sf_dir)
    draw = hash32("gap", F.col(KEY)) % 20
    return rows.withColumns({
        "y_pred": F.when(draw == 0, F.lit(None)).when(draw == 1, F.lit(float("nan"))).otherwise(F.col("y_pred")),
        "y_true": F.when(draw == 2, F.lit(None)).otherwise(F.col("y_true")),
    })


def study_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net prices with a reference column, gaps in a feature, and rows that occur twice."""
    rows = net_price(spark, sf_dir).withColumn("ref", hash32("ref", F.col(KEY)) % 3)
    gaps = rows.withColumn("l_tax", F.when(hash32("gap", F.col(KEY)) % 17 != 0, F.col("l_tax")))
    return gaps.unionByName(gaps.where(hash32("twice", F.col(KEY)) % 10 == 0))


def duplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a reference number, few distinct values, and missing ones."""
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") % 3).alias("ref"),
        "event_type",
        F.when(F.col("event_id") % 17 != 0, F.floor(F.col("value") / 10).cast("double")).alias("v"),
    )


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose value is sometimes NULL and sometimes NaN."""
    number = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "event_type",
        F.when(number % 17 == 0, F.lit(None)).when(number % 19 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
        .alias("v"),
    )


def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three parts per line item that can be scaled to 100."""
    return net_price(spark, sf_dir).select(
        KEY,
        (F.col("l_quantity") - 1).alias("a"),
        (F.col("l_discount") * 100).alias("b"),
        (F.col("l_tax") * 100).alias("c"),
    )


def derived_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An importance per (line state, supplier group): six by twenty, with ties."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.concat("l_returnflag", "l_linestatus").alias("model"),
            F.format_string("f%02d", F.col("l_suppkey") % 20).alias("feature"),
        )
        .agg(F.round(F.count(F.lit(1)) / 100, 0).alias("importance"))
    )
