"""Exact, centred robust scaling as a Spark ML stage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame

from varve.functions.columns import named
from varve.operators.quantiles import exact_quantiles, quantile_table

QUARTILES = [0.25, 0.5, 0.75]
LABEL = "_set_label"


class ExactRobustScaler(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Learn the exact median and interquartile range of each column.

    ``pyspark.ml.feature.RobustScaler`` uses sketches, does not centre unless
    told to, and maps a column without spread to 0; here such a column keeps
    the scale 1.
    """

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "ExactRobustScalerModel":
        return self._model(quantile_table(dataset, self.getInputCols(), QUARTILES))

    def _model(self, quartiles: dict[str, list]) -> "ExactRobustScalerModel":
        columns = self.getInputCols()
        empty = [c for c in columns if None in quartiles[c]]
        if empty:
            raise ValueError(f"no values to scale by in {empty}")
        return ExactRobustScalerModel()._set(
            inputCols=columns,
            outputCols=self.getOutputCols(),
            centres=[quartiles[c][1] for c in columns],
            scales=[(quartiles[c][2] - quartiles[c][0]) or 1.0 for c in columns],
        )

    def fit_sets(self, rows: DataFrame, label: Column, sets: dict[str, Sequence[str]]) -> dict[str, "ExactRobustScalerModel"]:
        """A model per named set of labels; each row has one label, a text, and sets may overlap.

        All sets share the same passes over the rows, so the folds of a study
        cost no more than one fit. A set without rows has no model.
        """
        columns = self.getInputCols()
        labelled = rows.select(*map(named, columns), label.cast("string").alias(LABEL))
        members = rows.sparkSession.createDataFrame(
            [(one, name) for name, labels in sets.items() for one in labels], "label string, member_of string"
        )
        found: dict[str, dict] = {}
        for r in exact_quantiles(labelled, columns, QUARTILES, [LABEL], members=members).collect():  # sets times columns
            found.setdefault(r["member_of"], {c: [None] * len(QUARTILES) for c in columns})[r["column"]][
                QUARTILES.index(r["p"])
            ] = r["value"]
        return {name: self._model(quartiles) for name, quartiles in found.items()}


class ExactRobustScalerModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    centres = Param(Params._dummy(), "centres", "median per column", TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "interquartile range per column, 1 if 0", TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        stages = zip(
            self.getInputCols(), self.getOutputCols(),
            self.getOrDefault(self.centres), self.getOrDefault(self.scales),
        )
        return dataset.withColumns({out: (named(c).cast("double") - m) / s for c, out, m, s in stages})
