"""Seeded random search over hyper-parameters, scored by cross-validation."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.functions.columns import finite_or_null, named
from varve.functions.hashing import uniform
from varve.operators.evaluation import ErrorEvaluator
from varve.operators.extra_trees import cross_validated_forests
from varve.operators.learners import (
    BASE_LEARNERS, EXTRA_DEPTH, EXTRA_TREES, MODEL_SEED, PARALLEL_FITS, UNUSED, fits_that_fit, in_parallel,
    preparation,
)
from varve.operators.splitting import FOLDS
from varve.session import materialise


@dataclass(frozen=True)
class Real:
    """A real number, uniform or uniform in its logarithm."""

    low: float
    high: float
    log: bool = False

    def draw(self, u: Column) -> Column:
        if not self.log:
            return F.lit(float(self.low)) + u * (self.high - self.low)
        low, high = F.ln(F.lit(float(self.low))), F.ln(F.lit(float(self.high)))
        return F.exp(low + u * (high - low))


@dataclass(frozen=True)
class Whole:
    """An integer of a range with a step, both ends included."""

    low: int
    high: int
    step: int = 1

    def draw(self, u: Column) -> Column:
        steps = (self.high - self.low) // self.step + 1
        return F.lit(self.low) + F.floor(u * steps).cast("int") * self.step


@dataclass(frozen=True)
class Choice:
    """One of a few options, as text."""

    options: tuple

    def draw(self, u: Column) -> Column:
        options = F.array(*[F.lit(str(o)) for o in self.options])
        return F.get(options, F.floor(u * len(self.options)).cast("int"))


# The search space of each tuned learner.
SPACES = {
    "xgb": {
        "eta": Real(0.01, 0.3),
        "max_depth": Whole(3, 8),
        "subsample": Real(0.7, 1.0),
        "colsample_bytree": Real(0.7, 1.0),
        "reg_lambda": Real(1e-2, 10, log=True),
        "reg_alpha": Real(1e-3, 1, log=True),
        "n_estimators": Whole(200, 800, 100),
    },
    "rf": {
        "n_estimators": Whole(200, 800, 100),
        "max_depth": Whole(5, 25),
        "min_samples_split": Whole(2, 10),
        "min_samples_leaf": Whole(1, 5),
        "max_features": Choice(("sqrt", "log2", 0.8)),
    },
    "lgb": {
        "num_leaves": Whole(20, 100),
        "learning_rate": Real(0.01, 0.3),
        "feature_fraction": Real(0.7, 1.0),
        "bagging_fraction": Real(0.7, 1.0),
        "bagging_freq": Whole(1, 7),
        "min_child_samples": Whole(5, 50),
        "reg_alpha": Real(1e-3, 1, log=True),
        "reg_lambda": Real(1e-3, 1, log=True),
        "n_estimators": Whole(200, 800, 100),
    },
}
# A space for the randomised trees, which the search grows together.
TREE_SPACE = {"n_estimators": Whole(2, 20), "max_depth": Whole(0, 15), "min_samples_leaf": Whole(1, 5)}
# Trials of each study.
TRIALS = {"xgb": 100, "rf": 100, "lgb": 50}
SEARCH_SEED = 42


def candidates(trials: DataFrame, space: dict, trial: str = "trial", seed: object = SEARCH_SEED) -> DataFrame:
    """Add one drawn value per parameter to each trial number."""
    drawn = {name: kind.draw(uniform(f"{seed}:{name}", F.col(trial))) for name, kind in space.items()}
    return trials.select(F.col(trial), *[v.alias(n) for n, v in drawn.items()])


# The fold under which a log keeps a score over all folds.
EVERY_FOLD = -1
LOG_SCHEMA = "key string, trial long, fold int, score double"


class TrialLog:
    """Scores of finished fits as rows of a table that is only appended to, so that a search can go on after its end.

    A row is written when its fit is scored. Its key follows from the learner,
    the label, the features and the setting; rows that were written twice are
    read once. A log belongs to one table and its folds.
    """

    def __init__(self, spark: SparkSession, path: str, study: Sequence[str] = ()):
        self.spark, self.path, self.study = spark, path, list(study)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        exists = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
        rows = spark.read.schema(LOG_SCHEMA).parquet(path).collect() if exists else []  # a row per fit
        self.known = {(r["key"], r["fold"]): r["score"] for r in rows}

    def key(self, setting: dict) -> str:
        return hashlib.md5(json.dumps([self.study, sorted((n, str(v)) for n, v in setting.items())]).encode()).hexdigest()

    def get(self, setting: dict, fold: int) -> float | None:
        return self.known.get((self.key(setting), fold))

    def add(self, setting: dict, trial: int, fold: int, score: float) -> None:
        row = (self.key(setting), trial, fold, float(score))
        self.spark.createDataFrame([row], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        self.known[row[0], fold] = row[3]


def cross_validate(
    make: Callable[[dict], Estimator], settings: Sequence[dict], rows: DataFrame, label: str, prediction: str,
    fold: str = "fold", folds: int = FOLDS, parallelism: int = PARALLEL_FITS, before: Estimator | None = None,
    log: TrialLog | None = None,
) -> list[float]:
    """Mean of the negated MAE over the folds that have rows, for each setting; NaN if none has.

    ``before`` (say, scaler and assembler) is fitted once per fold, on the rows
    outside it, and what it makes of the rows is written once for all settings.
    Every (setting, fold) is then an independent fit and score, several at a time.
    Scores that ``log`` has are not computed again; new ones are added to it.
    """
    judge = ErrorEvaluator(metric="mae", labelCol=label, predictionCol=prediction)

    def prepared(k: int) -> tuple[DataFrame, DataFrame]:
        train, test = rows.where(F.col(fold) != k), rows.where(F.col(fold) == k)
        if before is None:
            return train, test
        model = before.fit(train)
        return tuple(materialise(model.transform(x).select("features", named(label))) for x in (train, test))

    jobs = [(s, k) for s in range(len(settings)) for k in range(folds)]
    done = {(s, k): log.get(settings[s], k) for s, k in jobs} if log else {}
    needed = sorted({k for s, k in jobs if done.get((s, k)) is None})
    kept = dict(zip(needed, in_parallel(prepared, needed, parallelism)))

    def score(job: tuple[int, int]) -> float:
        setting, k = job
        if done.get(job) is not None:
            return done[job]
        train, test = kept[k]
        found = math.nan if test.isEmpty() else -judge.evaluate(make(settings[setting]).fit(train).transform(test))
        if log:
            log.add(settings[setting], setting, k, found)
        return found

    scores = in_parallel(score, jobs, fits_that_fit([train for train, _ in kept.values()], parallelism))
    found = []
    for s in range(len(settings)):
        own = [x for x in scores[s * folds : (s + 1) * folds] if not math.isnan(x)]
        found.append(sum(own) / len(own) if own else math.nan)
    return found


def search(
    learner: str, rows: DataFrame, features: Sequence[str], label: str, trials: int | None = None,
    space: dict | None = None, fold: str = "fold", folds: int = FOLDS, seed: object = SEARCH_SEED,
    parallelism: int = PARALLEL_FITS, log: str | None = None,
) -> DataFrame:
    """Trial table ``(trial, params, score, unused)`` of one learner.

    ``unused`` names the drawn parameters that Spark's learner has no use for.
    ``params`` maps names to text, as the categorical choice mixes words and
    numbers; ``read_params`` turns it back. ``log`` is a folder that keeps the
    score of each finished fit: a search that was stopped and is called again
    with the same log fits only what is missing.
    """
    spark = rows.sparkSession
    kept = TrialLog(spark, log, [learner, label, *features, str(folds)]) if log else None
    space = SPACES[learner] if space is None else space
    drawn = candidates(spark.range(TRIALS[learner] if trials is None else trials).withColumnRenamed("id", "trial"), space, seed=seed)
    picked = sorted(drawn.collect(), key=lambda r: r["trial"])
    settings = [{n: r[n] for n in space} for r in picked]
    make = lambda p: BASE_LEARNERS[learner](label, learner, read_params(p))
    if learner == "et":
        # Scaling moves thresholds along with the values, so these trees need none, and all settings share their scans.
        x = F.array(*[named(c).cast("double") for c in features])
        missing = [i for i, p in enumerate(settings) if kept is None or kept.get(p, EVERY_FOLD) is None]
        found = cross_validated_forests(
            rows.select(x.alias("x"), named(label).alias("y"), named(fold).alias("fold")),
            [{"max_depth": EXTRA_DEPTH, "n_estimators": EXTRA_TREES, "min_samples_leaf": 1} | read_params(settings[i]) for i in missing],
            folds, MODEL_SEED,
        )
        scores = dict(zip(missing, found))
        for i, p in enumerate(settings) if kept else ():
            if i in scores:
                kept.add(p, i, EVERY_FOLD, scores[i])
            else:
                scores[i] = kept.get(p, EVERY_FOLD)
        scores = [scores[i] for i in range(len(settings))]
    else:
        scores = cross_validate(
            make, settings, rows, label, learner, fold, folds, parallelism, preparation(features), kept
        )
    unused = [n for n in UNUSED.get(learner, ()) if n in space]
    table = [(r["trial"], {n: str(r[n]) for n in space}, s, unused) for r, s in zip(picked, scores)]
    return spark.createDataFrame(table, "trial long, params map<string,string>, score double, unused array<string>")


def read_params(params: dict) -> dict:
    """Numbers where the text is one, words elsewhere."""

    def value(v):
        if not isinstance(v, str):
            return v
        try:
            return int(v)
        except ValueError:
            pass
        try:
            return float(v)
        except ValueError:
            return v

    return {n: value(v) for n, v in params.items()}


def best_candidate(trials: DataFrame) -> DataFrame:
    """The trial with the highest score; among equals the lowest number.

    Trials without a score (NULL or NaN) are passed over; it is an error if none is left.
    """
    scored = trials.where(finite_or_null(F.col("score")).isNotNull())
    best = F.max_by(F.struct("trial", "params", "score"), F.struct("score", -F.col("trial")))
    none = F.raise_error(F.lit("no trial has a score"))
    return scored.agg(F.coalesce(best, none).alias("best")).select("best.*")
