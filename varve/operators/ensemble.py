"""Two ensembles over the base learners with a robust linear meta-learner."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasPredictionCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.functions.columns import named
from varve.operators.evaluation import report
from varve.operators.learners import PARALLEL_FITS, HuberLearner, add_predictions, fit_all, scalers_of_sets
from varve.operators.splitting import FOLDS, HOLDOUT_FRACTION, HOLDOUT_SEED, is_holdout

META = "_meta_features"


ALL, SEEN = "all", "seen"
Scalers = dict[tuple[str, str], Model]


def study_scalers(
    bases: dict[str, Estimator], rows: DataFrame, key: str, fold: str = "fold", folds: int = FOLDS,
    fraction: float = HOLDOUT_FRACTION, seed: object = HOLDOUT_SEED,
) -> Scalers:
    """The scalers of every fit of a study, from the same passes over its training rows.

    Sets are all rows, those outside each fold, and those outside the hold-out.
    """
    label = F.concat(F.col(fold).cast("string"), F.when(is_holdout(named(key), fraction, seed), "h").otherwise("s"))
    labels = [f"{k}{part}" for k in range(folds) for part in "hs"]
    sets = {ALL: labels, SEEN: [x for x in labels if x[-1] == "s"]}
    sets |= {_without(k): [x for x in labels if x[:-1] != str(k)] for k in range(folds)}
    return scalers_of_sets(bases, rows, label, sets)


def _without(k: int) -> str:
    return f"without {k}"


def fold_fits(
    bases: dict[str, Estimator], rows: DataFrame, fold: str = "fold", folds: int = FOLDS
) -> tuple[dict[tuple[str, int], tuple[Estimator, DataFrame]], dict[int, str]]:
    """The (estimator, rows) pairs of the fits outside each fold, and the names of their sets of rows, for ``fit_all``."""
    others = [rows.where(F.col(fold) != k) for k in range(folds)]
    jobs = {(name, k): (est, others[k]) for k in range(folds) for name, est in bases.items()}
    return jobs, {id(others[k]): _without(k) for k in range(folds)}


def holdout_fits(
    bases: dict[str, Estimator], rows: DataFrame, key: str, fraction: float = HOLDOUT_FRACTION, seed: object = HOLDOUT_SEED
) -> tuple[dict[tuple[str, str], tuple[Estimator, DataFrame]], dict[int, str]]:
    """The same for the fits outside the hold-out."""
    seen = rows.where(~is_holdout(named(key), fraction, seed))
    return {("part", n): (e, seen) for n, e in bases.items()}, {id(seen): SEEN}


def out_of_fold(
    bases: dict[str, Estimator], rows: DataFrame, fold: str = "fold", folds: int = FOLDS, parallelism: int = PARALLEL_FITS,
    scalers: Scalers | None = None, parts: dict | None = None,
) -> tuple[DataFrame, dict[tuple[str, int], Model]]:
    """Predict each row by models that never saw its fold.

    Returns the rows with one column per base learner, and the fitted models
    (``parts`` when they exist already, by the keys of ``fold_fits``).
    A fold is scored by all base learners in one pass, so the columns come
    side by side without a join; each row is scored once per learner. The
    scalers of all folds come from the same passes over the rows.
    """
    if parts is None:
        jobs, names = fold_fits(bases, rows, fold, folds)
        if scalers is None:
            labels = [*map(str, range(folds)), "other"]
            sets = {_without(k): [x for x in labels if x != str(k)] for k in range(folds)}
            label = F.when(F.col(fold).isin(*range(folds)), F.col(fold).cast("string")).when(F.col(fold).isNotNull(), "other")
            scalers = scalers_of_sets(bases, rows, label, sets)
        parts = fit_all(jobs, parallelism, scalers, names)
    fitted = {(name, k): parts[(name, k)] for k in range(folds) for name in bases}
    scored = [
        add_predictions({name: fitted[(name, k)] for name in bases}, rows.where(F.col(fold) == k))
        for k in range(folds)
    ]
    return functools.reduce(lambda a, b: a.unionByName(b), scored), fitted


def column_stack(predictions: DataFrame, models: Sequence[str], key: str = "row_key") -> DataFrame:
    """One column per model from a long prediction table: a single aggregation."""
    return predictions.groupBy(named(key)).pivot("model", list(models)).agg(F.first("y_pred"))


def fit_meta(rows: DataFrame, inputs: Sequence[str], label: str, meta: HuberLearner, prediction: str) -> Model:
    pairs = _assemble(rows, inputs).select(META, named(label))
    return meta.copy({meta.featuresCol: META, meta.labelCol: label, meta.predictionCol: prediction}).fit(pairs)


def _assemble(rows: DataFrame, inputs: Sequence[str]) -> DataFrame:
    # Assemble from names without symbols, which the assembler would parse.
    plain = [f"_m{i}" for i in range(len(inputs))]
    renamed = rows.select("*", *[named(c).cast("double").alias(p) for c, p in zip(inputs, plain)])
    return VectorAssembler(inputCols=plain, outputCol=META).transform(renamed)


class _Ensemble(Estimator, HasPredictionCol, MLReadable, MLWritable):
    """Base learners and a meta-learner, which are estimators themselves, and params for the rest.

    ``copy`` (and so a param grid) reaches the parts, too, and all is saved and
    loaded. ``fitted`` are base models that exist already, ``parts`` those that
    have not seen some of the rows (by the keys of ``fold_fits`` or
    ``holdout_fits``), ``scalers`` the fitted scalers of their sets of rows
    (``study_scalers``); none of these is saved.
    """

    labelName = Param(Params._dummy(), "labelName", "observed column", TypeConverters.toString)
    baseNames = Param(Params._dummy(), "baseNames", "base learners, in order", TypeConverters.toListString)
    ownBases = Param(Params._dummy(), "ownBases", "whether base learners are stored with it", TypeConverters.toBoolean)
    parallelism = Param(Params._dummy(), "parallelism", "fits at a time", TypeConverters.toInt)

    def __init__(self, bases, label, prediction, meta, fitted, parallelism, scalers, parts):
        super().__init__()
        self.bases, self.meta, self.fitted, self.scalers = dict(bases or {}), meta or HuberLearner(), fitted, scalers
        self.parts = parts
        self._set(
            labelName=label, predictionCol=prediction, parallelism=parallelism, baseNames=list(self.bases), ownBases=True
        )

    def copy(self, extra=None):
        that = super().copy(extra)
        that.bases = {n: b.copy(extra) for n, b in self.bases.items()}
        that.meta = self.meta.copy(extra)
        return that

    def write(self) -> MLWriter:
        return _EnsembleWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _EnsembleReader(cls)

    def _model(self, final: dict[str, Model], meta: Model, inputs: Sequence[str]) -> "EnsembleModel":
        return EnsembleModel(final, meta)._set(
            inputCols=inputs, labelName=self.getOrDefault("labelName"), predictionCol=self.getPredictionCol()
        )


class FoldStack(_Ensemble):
    """Stacking: the meta-learner learns from out-of-fold predictions.

    With ``passthrough`` it also sees the unscaled features. The base learners
    that predict later are fitted on all rows; pass them as ``fitted`` when
    they exist already.
    """

    featureNames = Param(Params._dummy(), "featureNames", "feature columns", TypeConverters.toListString)
    foldCol = Param(Params._dummy(), "foldCol", "column with the fold of a row", TypeConverters.toString)
    folds = Param(Params._dummy(), "folds", "number of folds", TypeConverters.toInt)
    passthrough = Param(Params._dummy(), "passthrough", "show the features to the meta-learner", TypeConverters.toBoolean)

    def __init__(
        self, bases: dict[str, Estimator] | None = None, features: Sequence[str] = (), label: str = "label",
        prediction: str = "stack", fold: str = "fold", folds: int = FOLDS, passthrough: bool = True,
        meta: HuberLearner | None = None, fitted: dict[str, Model] | None = None, parallelism: int = PARALLEL_FITS, scalers: Scalers | None = None,
        parts: dict | None = None,
    ):
        super().__init__(bases, label, prediction, meta, fitted, parallelism, scalers, parts)
        self._set(featureNames=list(features), foldCol=fold, folds=folds, passthrough=passthrough)

    def _fit(self, dataset: DataFrame) -> "EnsembleModel":
        at_a_time = self.getOrDefault("parallelism")
        rows, _ = out_of_fold(
            self.bases, dataset, self.getOrDefault("foldCol"), self.getOrDefault("folds"), at_a_time, self.scalers, self.parts
        )
        inputs = [*self.bases, *(self.getOrDefault("featureNames") if self.getOrDefault("passthrough") else [])]
        meta = fit_meta(rows, inputs, self.getOrDefault("labelName"), self.meta, self.getPredictionCol())
        final = self.fitted or fit_all(
            {n: (e, dataset) for n, e in self.bases.items()}, at_a_time, self.scalers, {id(dataset): ALL}
        )
        return self._model(final, meta, inputs)


class HoldoutBlend(_Ensemble):
    """Blending: the meta-learner learns from predictions on a held-out share.

    It is fitted on the output of models that saw the other rows, and applied
    to models fitted on all rows (``fitted`` when they exist already).
    """

    keyName = Param(Params._dummy(), "keyName", "column that identifies rows", TypeConverters.toString)
    fraction = Param(Params._dummy(), "fraction", "share that is held out", TypeConverters.toFloat)
    holdoutSeed = Param(Params._dummy(), "holdoutSeed", "seed of the held-out share", TypeConverters.toString)

    def __init__(
        self, bases: dict[str, Estimator] | None = None, key: str = "key", label: str = "label", prediction: str = "blend",
        fraction: float = HOLDOUT_FRACTION, seed: object = HOLDOUT_SEED, meta: HuberLearner | None = None,
        fitted: dict[str, Model] | None = None, parallelism: int = PARALLEL_FITS, scalers: Scalers | None = None,
        parts: dict | None = None,
    ):
        super().__init__(bases, label, prediction, meta, fitted, parallelism, scalers, parts)
        self._set(keyName=key, fraction=fraction, holdoutSeed=str(seed))

    def _fit(self, dataset: DataFrame) -> "EnsembleModel":
        key, share = self.getOrDefault("keyName"), self.getOrDefault("fraction")
        seed = self.getOrDefault("holdoutSeed")
        held_out = is_holdout(named(key), share, seed)
        partial, names = ({}, {}) if self.parts else holdout_fits(self.bases, dataset, key, share, seed)
        whole = {} if self.fitted else {("all", n): (e, dataset) for n, e in self.bases.items()}
        label = F.when(held_out, "h").otherwise("s")
        scalers, jobs = self.scalers, {**partial, **whole}
        if jobs and not scalers:
            scalers = scalers_of_sets(self.bases, dataset, label, {SEEN: ["s"], **({ALL: ["h", "s"]} if whole else {})})
        fits = fit_all(jobs, self.getOrDefault("parallelism"), scalers, {**names, id(dataset): ALL}) if jobs else {}
        fits |= self.parts or {}
        rows = add_predictions({n: fits[("part", n)] for n in self.bases}, dataset.where(held_out))
        meta = fit_meta(rows, list(self.bases), self.getOrDefault("labelName"), self.meta, self.getPredictionCol())
        final = self.fitted or {n: fits[("all", n)] for n in self.bases}
        return self._model(final, meta, list(self.bases))


class EnsembleModel(Model, HasInputCols, HasPredictionCol, MLReadable, MLWritable):
    """Base models side by side, then the meta-model: one pass, no join."""

    labelName = Param(Params._dummy(), "labelName", "observed column, for evaluate", TypeConverters.toString)
    baseNames = Param(Params._dummy(), "baseNames", "base learners, in order", TypeConverters.toListString)
    ownBases = Param(Params._dummy(), "ownBases", "whether base models are stored with it", TypeConverters.toBoolean)

    def __init__(self, bases: dict[str, Model] | None = None, meta: Model | None = None):
        super().__init__()
        self.bases, self.meta = bases or {}, meta
        self._set(baseNames=list(self.bases), ownBases=True)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if set(self.bases) & set(dataset.columns):
            raise ValueError("the rows already carry base predictions: use combine")
        return self.combine(add_predictions(self.bases, dataset)).drop(*self.bases)

    def combine(self, with_bases: DataFrame) -> DataFrame:
        """The meta-model alone, on rows that carry the base predictions."""
        name = self.getPredictionCol()
        scored = self.meta.transform(_assemble(with_bases, self.getInputCols()))
        return scored.select(*map(named, with_bases.columns), named(name))

    def detached(self) -> "EnsembleModel":
        """The ensemble without its base models, to be stored next to them."""
        alone = self._copyValues(EnsembleModel({}, self.meta))
        return alone._set(baseNames=list(self.bases), ownBases=False)

    def evaluate(self, dataset: DataFrame) -> float:
        """R² on rows with observed values."""
        label, name = self.getOrDefault(self.labelName), self.getPredictionCol()
        pairs = self.transform(dataset).select(named(label).alias("y_true"), named(name).alias("y_pred"))
        return report(pairs, by=(), metrics=["r2"]).first()["r2"]

    def write(self) -> MLWriter:
        return _EnsembleWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _EnsembleReader(cls)


class _EnsembleWriter(DefaultParamsWriter):
    """Own metadata, then each part with its own writer below it."""

    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        for name, model in self.instance.bases.items():
            model.write().save(f"{path}/bases/{name}")
        self.instance.meta.write().save(f"{path}/meta")


class _EnsembleReader(DefaultParamsReader):
    """For ensembles and for their models."""

    def load(self, path: str):
        model = super().load(path)
        names = model.getOrDefault(model.baseNames) if model.getOrDefault(model.ownBases) else []
        # The class of each part is in its own metadata.
        model.bases = {n: self.loadParamsInstance(f"{path}/bases/{n}", self.sparkSession) for n in names}
        model.meta = self.loadParamsInstance(f"{path}/meta", self.sparkSession)
        return model
