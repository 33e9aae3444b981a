"""Feature importance: from split gains, from the nodes of trees, and by permutation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varve.functions import errors
from varve.functions.columns import named
from varve.operators.evaluation import long_predictions, report
from varve.operators.extra_trees import ExtraTreesModel
from varve.operators.permute import with_lent_values
from varve.session import new_path

# Repeats and seed of a permutation, and lengths of the rankings.
REPEATS, SHUFFLE_SEED = 20, 42
TOP_PER_MODEL, TOP_BY_GAIN, TOP_BY_PERMUTATION = 15, 12, 10
# What a split can count for.
KINDS = ("splits", "gain", "cover")


def impurity_importance(spark: SparkSession, models: dict[str, Model], features: Sequence[str]) -> DataFrame:
    """Rows ``(model, feature, importance)`` from fitted base pipelines.

    Features times models numbers, read from the models themselves.
    """
    rows = [
        (name, feature, float(share))
        for name, model in models.items()
        for feature, share in zip(features, model.stages[-1].featureImportances.toArray())
    ]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


def node_table(spark: SparkSession, model: Model) -> DataFrame:
    """The nodes of a tree ensemble or of a pipeline that ends in one.

    Columns: tree, node, ``left`` and ``right`` (children in the same tree, -1 in a leaf), ``feature`` (its place, -1 in a leaf), ``threshold`` (rows up to it
    go left), ``value``, ``n`` (training rows, with Spark's forests as often as the
    bootstrap drew them) and ``gain`` (of impurity per row).

    Spark's models are stored below the shared folder and their node files read,
    so trees of any number and size stay out of the driver's Python.
    """
    tree = model.stages[-1] if hasattr(model, "stages") else model
    if isinstance(tree, ExtraTreesModel):
        inner = F.col("feature") >= 0
        return tree.node_table(spark).select(
            F.col("tree").cast("int").alias("tree"), F.col("node").cast("long").alias("node"),
            F.col("left").cast("long").alias("left"), F.when(inner, F.col("left") + 1).otherwise(F.lit(-1)).cast("long").alias("right"),
            F.col("feature").cast("int").alias("feature"), F.when(inner, F.col("threshold")).alias("threshold"),
            "value", F.col("count").cast("long").alias("n"),
            # Gains of these trees are sums over the rows of the node.
            F.when(inner, F.col("gain") / F.col("count")).otherwise(F.lit(0.0)).alias("gain"),
        )
    path = new_path(spark, "nodes")
    tree.write().save(path)
    data = F.col("nodeData")
    inner = data["leftChild"] >= 0
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), data["id"].cast("long").alias("node"),
        data["leftChild"].cast("long").alias("left"), data["rightChild"].cast("long").alias("right"),
        data["split"]["featureIndex"].alias("feature"),
        F.when(inner, F.get(data["split"]["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        data["prediction"].alias("value"), data["rawCount"].alias("n"),
        F.when(inner, data["gain"]).otherwise(F.lit(0.0)).alias("gain"),
    )


def split_importance(spark: SparkSession, models: dict[str, Model], features: Sequence[str], kind: str = "splits") -> DataFrame:
    """Rows ``(model, feature, importance)`` by aggregation over the nodes, not normalised.

    ``splits`` counts the splits on a feature, ``gain`` adds up how far they lower
    the sum of squares, ``cover`` the training rows that pass them. A feature
    without a split has 0.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    worth = {"splits": F.lit(1.0), "gain": F.col("gain") * F.col("n"), "cover": F.col("n").cast("double")}[kind]
    every = spark.createDataFrame([(i, f) for i, f in enumerate(features)], "place int, feature string")
    found = None
    for name, model in models.items():
        sums = node_table(spark, model).where("feature >= 0").groupBy(F.col("feature").alias("at")).agg(F.sum(worth).alias("importance"))
        rows = every.join(F.broadcast(sums), F.col("place") == F.col("at"), "left").select(  # a row per feature
            F.lit(name).alias("model"), "feature", F.coalesce("importance", F.lit(0.0)).alias("importance")
        )
        found = rows if found is None else found.unionByName(rows)
    return found


def permutation_importance(
    df: DataFrame,
    predict: Callable[[DataFrame], DataFrame],
    models: Sequence[str],
    features: Sequence[str],
    label: str,
    key: str,
    repeats: int = REPEATS,
    seed: object = SHUFFLE_SEED,
) -> DataFrame:
    """Mean drop of R² when one feature at a time is permuted over the whole table.

    ``predict`` adds one column per model and keeps all others. All models,
    features and repeats run as one job: one join brings the lent values to
    their rows, and the errors combine on the map side.
    """
    features, models = list(features), list(models)
    rows = df.select(named(key), named(label), *map(named, features))
    long = long_predictions(predict(rows), {m: named(m) for m in models}, [], label)
    baseline = report(long, by=["model"], metrics=["r2"]).select(F.col("model").alias("of"), F.col("r2").alias("baseline"))

    swapped = with_lent_values(rows, key, features, repeats, seed).select(
        "which", "repeat", named(label),
        *[F.when(F.col("which") == i, F.col("lent")).otherwise(named(f)).alias(f) for i, f in enumerate(features)],
    )
    names = F.array(*[F.lit(f) for f in features])
    # All models of a row are added up side by side; a row per feature and repeat leaves the aggregation.
    r2 = [errors.r_squared(named(label).cast("double"), named(m).cast("double")).alias(f"_r2_{i}") for i, m in enumerate(models)]
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"_r2_{i}").alias("r2")) for i, m in enumerate(models)])
    scores = (
        predict(swapped).groupBy("which", "repeat").agg(*r2)
        .select("which", F.inline(cells))
        .groupBy("model", F.get(names, F.col("which")).alias("feature"))
        .agg(F.avg("r2").alias("permuted"))
    )
    return scores.join(F.broadcast(baseline), F.col("model") == F.col("of")).select(  # one row per model
        "model", "feature", (F.col("baseline") - F.col("permuted")).alias("importance")
    )


def mean_importance(importances: DataFrame, normalise: bool = True) -> DataFrame:
    """Mean over models per feature.

    With ``normalise`` each model's importances first become shares of their
    sum, so that split counts and gains count alike.
    """
    rows = importances
    if normalise:
        totals = rows.groupBy("model").agg(F.sum("importance").alias("total"))
        rows = rows.join(F.broadcast(totals), "model").withColumn(  # one row per model
            "importance", F.coalesce(F.try_divide("importance", "total"), F.lit(0.0))
        )
    return rows.groupBy("feature").agg(F.avg("importance").alias("importance"))


def top_per_model(importances: DataFrame, k: int = TOP_PER_MODEL) -> DataFrame:
    """The ``k`` leading features of each model; ties go by feature name."""
    order = Window.partitionBy("model").orderBy(F.desc("importance"), "feature")
    return importances.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_overall(importances: DataFrame, k: int, normalise: bool = True) -> DataFrame:
    """Each model's value for the ``k`` features that lead on average."""
    means = mean_importance(importances, normalise).withColumnRenamed("importance", "mean_importance")
    leading = means.orderBy(F.desc("mean_importance"), "feature").limit(k)
    ranked = leading.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("mean_importance"), "feature"))  # k rows
    )
    return importances.join(F.broadcast(ranked), "feature")
