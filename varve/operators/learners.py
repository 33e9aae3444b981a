"""Base learners and the robust linear meta-learner, as Spark ML estimators.

Each base learner is a pipeline scaler -> assembler -> model, so the scaler is
fitted on exactly the rows its model sees.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterable, Sequence
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession

from varve.functions.columns import named
from varve.operators.binned_trees import BinnedBoosting, BinnedForest, ValueSums
from varve.operators.extra_trees import ExtraTreesLearner
from varve.operators.scaling import ExactRobustScaler, ExactRobustScalerModel

# Fits that run at a time; each is a series of jobs that leaves cores idle in between.
PARALLEL_FITS = 8
# Bytes that a tree learner keeps of a row while it is fitted; the randomised trees keep most, the features and the label as they are.
FIT_ROW_BYTES = 100

# Defaults of the learners.
MODEL_SEED = 42
HUBER_EPSILON, HUBER_ITERATIONS, HUBER_ALPHA = 1.35, 1000, 1e-4
EXTRA_TREES, EXTRA_DEPTH = 100, 15


def boosted(label: str, prediction: str, params: dict | None = None) -> GBTRegressor:
    """Depth-wise boosting. Parameters carry the names of the search space.

    ``reg_lambda`` and ``reg_alpha`` are accepted and not used: Spark's
    boosting has no leaf penalty.
    """
    p = {"eta": 0.3, "max_depth": 6, "subsample": 1.0, "colsample_bytree": 1.0, "n_estimators": 100, **(params or {})}
    return BinnedBoosting(
        featuresCol="features", labelCol=label, predictionCol=prediction, lossType="squared",
        stepSize=float(p["eta"]), maxDepth=int(p["max_depth"]), subsamplingRate=float(p["subsample"]),
        featureSubsetStrategy=_subset(p["colsample_bytree"]), maxIter=int(p["n_estimators"]), seed=MODEL_SEED,
    )


def boosted_by_leaves(label: str, prediction: str, params: dict | None = None) -> GBTRegressor:
    """Boosting sized by a number of leaves, on finer histograms.

    Trees grow depth-wise to the depth that holds ``num_leaves``; the leaf
    penalties and ``bagging_freq`` (a sample per tree is drawn anyway) are
    accepted and not used.
    """
    p = {
        "num_leaves": 31, "learning_rate": 0.1, "feature_fraction": 1.0, "bagging_fraction": 1.0,
        "min_child_samples": 20, "n_estimators": 100, **(params or {}),
    }
    return BinnedBoosting(
        featuresCol="features", labelCol=label, predictionCol=prediction, lossType="squared",
        stepSize=float(p["learning_rate"]), maxDepth=math.ceil(math.log2(p["num_leaves"])),
        subsamplingRate=float(p["bagging_fraction"]), featureSubsetStrategy=_subset(p["feature_fraction"]),
        minInstancesPerNode=int(p["min_child_samples"]), maxIter=int(p["n_estimators"]), maxBins=255,
        seed=MODEL_SEED,
    )


def bagged_forest(label: str, prediction: str, params: dict | None = None) -> RandomForestRegressor:
    """Bootstrap forest. ``min_samples_split`` acts through the leaf size.

    A node of fewer than ``min_samples_split`` rows cannot split when each leaf
    needs half of them, rounded up.
    """
    p = {
        "n_estimators": 100, "max_depth": 10, "min_samples_split": 2, "min_samples_leaf": 1,
        "max_features": 1.0, **(params or {}),
    }
    return BinnedForest(
        featuresCol="features", labelCol=label, predictionCol=prediction,
        numTrees=int(p["n_estimators"]), maxDepth=int(p["max_depth"]),
        minInstancesPerNode=max(int(p["min_samples_leaf"]), math.ceil(p["min_samples_split"] / 2)),
        featureSubsetStrategy=_subset(p["max_features"]), bootstrap=True, seed=MODEL_SEED,
    )


def randomised_trees(label: str, prediction: str, params: dict | None = None) -> ExtraTreesLearner:
    p = {"n_estimators": EXTRA_TREES, "max_depth": EXTRA_DEPTH, **(params or {})}
    return ExtraTreesLearner(
        featuresCol="features", labelCol=label, predictionCol=prediction,
        numTrees=int(p["n_estimators"]), maxDepth=int(p["max_depth"]),
        minInstancesPerNode=int(p.get("min_samples_leaf", 1)), seed=MODEL_SEED,
    )


def _subset(share: str | float) -> str:
    """Spark's name for a share of the features: a word or a fraction as text."""
    if isinstance(share, str):
        return share
    return "all" if float(share) >= 1.0 else str(float(share))


# Parameters of the search spaces that these learners have no use for.
UNUSED = {"xgb": ("reg_lambda", "reg_alpha"), "lgb": ("bagging_freq", "reg_alpha", "reg_lambda")}

# The four base learners by name.
BASE_LEARNERS = {"xgb": boosted, "rf": bagged_forest, "lgb": boosted_by_leaves, "et": randomised_trees}


def preparation(features: Sequence[str]) -> Pipeline:
    """Scaler and assembler over the named feature columns."""
    scaled_names = [f"_scaled_{i}" for i in range(len(features))]
    return Pipeline(stages=[
        ExactRobustScaler(inputCols=list(features), outputCols=scaled_names),
        VectorAssembler(inputCols=scaled_names, outputCol="features", handleInvalid="error"),
    ])


def scaled(learner: Estimator, features: Sequence[str]) -> Pipeline:
    """Scaler, assembler and learner, fitted together."""
    return Pipeline(stages=[*preparation(features).getStages(), learner])


def base_learners(
    features: Sequence[str], label: str, params: dict[str, dict] | None = None, names: Sequence[str] | None = None
) -> dict[str, Pipeline]:
    """The base learners, each predicting into a column of its own name.

    They share one scaler and one assembler, which ``fit_all`` fits once per
    set of rows.
    """
    params = params or {}
    shared = preparation(features).getStages()
    return {
        name: Pipeline(stages=[*shared, BASE_LEARNERS[name](label, name, params.get(name))])
        for name in (names or BASE_LEARNERS)
    }


def add_prediction(model: Model, df: DataFrame, name: str) -> DataFrame:
    """Add one prediction column and none of the working columns."""
    return model.transform(df).select(*map(named, df.columns), named(name))


def add_predictions(models: dict[str, Model], df: DataFrame) -> DataFrame:
    """A column per model in one pass over the rows: no join, no shuffle.

    Models behind the same fitted scaler and assembler share what these make of
    a row.
    """
    given, alike = df.columns, {}
    for name, model in models.items():
        alike.setdefault(_preparation(model) or name, {})[name] = model
    for same in alike.values():
        if len(same) == 1:
            (name, model), = same.items()
            df = add_prediction(model, df, name)
            continue
        before, columns = next(iter(same.values())).stages[:-1], df.columns
        df = PipelineModel(stages=before).transform(df)
        for model in same.values():
            df = model.stages[-1].transform(df)
        df = df.select(*map(named, columns), *map(named, same))
    return df.select(*map(named, given), *map(named, models))


def _preparation(model: Model) -> tuple | None:
    """What tells the stages before the last apart, if their params say all about them; a loaded copy is the same."""
    before = model.stages[:-1] if isinstance(model, PipelineModel) else []
    if not before or not all(isinstance(s, (ExactRobustScalerModel, VectorAssembler)) for s in before):
        return None
    return tuple((s.uid, tuple(sorted((p.name, repr(v)) for p, v in s.extractParamMap().items()))) for s in before)


def scalers_of_sets(
    bases: dict[str, Estimator], rows: DataFrame, label: Column, sets: dict[str, Sequence[str]]
) -> dict[tuple[str, str], Model]:
    """The scalers of the pipelines, fitted on each set of labels in the same passes: by (uid of the scaler, set)."""
    stages = [p.getStages()[0] for p in bases.values() if isinstance(p, Pipeline) and p.getStages()]
    distinct = {s.uid: s for s in stages if isinstance(s, ExactRobustScaler)}
    return {(uid, name): m for uid, s in distinct.items() for name, m in s.fit_sets(rows, label, sets).items()}


def fit_all(
    jobs: dict, parallelism: int = PARALLEL_FITS, scalers: dict[tuple[str, str], Model] | None = None,
    sets: dict[int, str] | None = None,
) -> dict:
    """Fit independent (pipeline, rows) pairs, several Spark jobs at a time.

    Pipelines that share their first stages share the fit of these on the same
    rows; the fitted models are complete pipelines all the same. ``scalers`` are
    fitted already, by (uid, name of a set of rows); ``sets`` names the sets by
    the ``id`` of their rows.
    """
    scalers, sets = scalers or {}, sets or {}

    def shared(key) -> tuple:
        pipeline, rows = jobs[key]
        return (*[id(stage) for stage in pipeline.getStages()[:-1]], id(rows))

    def fit_first(key) -> PipelineModel:
        pipeline, rows = jobs[key]
        stages = [scalers.get((s.uid, sets.get(id(rows))), s) for s in pipeline.getStages()[:-1]]
        return Pipeline(stages=stages).fit(rows)

    parallelism = fits_that_fit({id(rows): rows for _, rows in jobs.values()}.values(), parallelism)
    first = {shared(key): key for key in jobs}
    prepared = dict(zip(first, in_parallel(fit_first, list(first.values()), parallelism)))

    counted = {}

    def fit(key) -> PipelineModel:
        pipeline, rows = jobs[key]
        before = prepared[shared(key)]
        learner = pipeline.getStages()[-1].copy()
        if isinstance(learner, (BinnedBoosting, BinnedForest)):
            # Learners on the same rows count their values once.
            learner.sums = counted.setdefault((shared(key), learner.getFeaturesCol(), learner.getLabelCol()), ValueSums())
        # A last stage with a formula has nothing to fit.
        last = learner.fit(before.transform(rows)) if isinstance(learner, Estimator) else learner
        return PipelineModel(stages=[*before.stages, last])

    return dict(zip(jobs, in_parallel(fit, list(jobs), parallelism)))


def fits_that_fit(tables: Iterable[DataFrame], parallelism: int = PARALLEL_FITS) -> int:
    """How many fits may run side by side, up to ``parallelism``, so that what they keep stays in memory.

    Each fit goes over its rows some hundred times. Rows that do not stay in
    memory are written, read and turned into objects again each time, so that
    fits of large tables side by side take far longer than one after the other.
    """
    tables = list(tables)
    if parallelism < 2 or not tables:
        return parallelism
    kept = FIT_ROW_BYTES * max(in_parallel(lambda rows: rows.count(), tables, parallelism))
    return max(1, min(parallelism, storage_bytes(tables[0].sparkSession) // max(1, kept)))


def storage_bytes(spark: SparkSession) -> int:
    """Memory for kept rows over all executors; in a cluster the driver's share does not count."""
    context = spark.sparkContext
    found = context._jsc.sc().getExecutorMemoryStatus().values().iterator()
    sizes = []
    while found.hasNext():
        sizes.append(found.next()._1())
    return sum(sizes) if len(sizes) == 1 else sum(sizes) * (len(sizes) - 1) // len(sizes)


def in_parallel(work: Callable, items: Sequence, parallelism: int = PARALLEL_FITS) -> list:
    """Run driver-side steps, each a series of Spark jobs, on a few threads."""
    session = SparkSession.builder.getOrCreate()
    with ThreadPool(max(1, min(parallelism, len(items)))) as pool:
        return pool.map(inheritable_thread_target(session)(work), items)


@contextmanager
def held(df: DataFrame, source: DataFrame):
    """Keep rows at hand for the jobs of one fit, on disk where memory ends.

    Rows that are a projection of a ``source`` that is kept already are not kept twice.
    """
    if source.storageLevel.useMemory or source.storageLevel.useDisk:
        yield df
        return
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


class HuberLearner(
    Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, HasMaxIter, DefaultParamsReadable, DefaultParamsWritable
):
    """Huber regression with a jointly fitted scale and an L2 penalty ``alpha``.

    Spark averages the loss over rows where the published objective sums it,
    so the penalty becomes ``alpha / n``.
    """

    epsilon = Param(Params._dummy(), "epsilon", "where the loss turns linear, in scales", TypeConverters.toFloat)
    alpha = Param(Params._dummy(), "alpha", "L2 penalty of the summed loss", TypeConverters.toFloat)

    @keyword_only
    def __init__(
        self, *, featuresCol="features", labelCol="label", predictionCol="prediction",
        epsilon=HUBER_EPSILON, alpha=HUBER_ALPHA, maxIter=HUBER_ITERATIONS,
    ):
        super().__init__()
        self._setDefault(epsilon=HUBER_EPSILON, alpha=HUBER_ALPHA, maxIter=HUBER_ITERATIONS)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame):
        rows = dataset.select(named(self.getFeaturesCol()), named(self.getLabelCol()))
        with held(rows, dataset) as rows:
            n = rows.count()
            # Each of many iterations costs a task per partition: no more than run at a time.
            rows = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)
            model = LinearRegression(
                featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(),
                predictionCol=self.getPredictionCol(), loss="huber",
                epsilon=self.getOrDefault(self.epsilon), maxIter=self.getMaxIter(), tol=1e-9,
                standardization=False, regParam=self.getOrDefault(self.alpha) / max(1, n),
            ).fit(rows)
        if model.hasSummary and model.summary.totalIterations >= self.getMaxIter():
            warnings.warn(f"the Huber fit stopped after {self.getMaxIter()} iterations", stacklevel=2)
        return model
