"""Models that share their scaler share its output, and the fits of a study run in one pool."""

import pytest
from pyspark.sql import functions as F

from varve.operators import ensemble, learners
from varve.operators.ensemble import FoldStack, HoldoutBlend, fold_fits, holdout_fits
from varve.operators.learners import add_prediction, add_predictions, base_learners, fit_all
from varve.plans import study
from varve.sources.model_store import load_models, save_models

FEATURES = ["a", "b (%)"]
SMALL = {
    "xgb": {"n_estimators": 2, "max_depth": 2}, "rf": {"n_estimators": 2, "max_depth": 3},
    "lgb": {"n_estimators": 2, "num_leaves": 4, "min_child_samples": 2}, "et": {"n_estimators": 2, "max_depth": 3},
}


@pytest.fixture(scope="module")
def rows(spark):
    id_ = F.col("id")
    return spark.range(400).select(
        id_.cast("string").alias("key"), (id_ % 5).cast("int").alias("fold"), (id_ % 17).cast("double").alias("a"),
        (id_ % 11).cast("double").alias("b (%)"), (3 * (id_ % 17) + id_ % 11).cast("double").alias("y"),
    ).persist()


@pytest.fixture(scope="module")
def models(rows):
    return fit_all({n: (e, rows) for n, e in base_learners(FEATURES, "y", SMALL).items()})


@pytest.fixture
def scalings(monkeypatch):
    seen, transform = [], learners.ExactRobustScalerModel._transform
    monkeypatch.setattr(
        learners.ExactRobustScalerModel, "_transform", lambda self, df: seen.append(self.uid) or transform(self, df)
    )
    return seen


def alone(models, df):
    for name, model in models.items():
        df = add_prediction(model, df, name)
    return df


def test_models_behind_one_scaler_scale_once(spark, rows, models, scalings, tmp_path):
    together = add_predictions(models, rows)
    assert len(scalings) == 1 and together.columns == [*rows.columns, "xgb", "rf", "lgb", "et"]
    want = sorted(alone(models, rows).collect())
    assert sorted(together.collect()) == want
    save_models(spark, models, str(tmp_path / "m"))
    loaded = load_models(spark, str(tmp_path / "m"))
    scalings.clear()
    again = study.score(loaded, rows)
    assert len(scalings) == 1 and sorted(again.collect()) == want


def test_scalers_of_other_rows_are_not_shared(rows, models, scalings):
    bases = base_learners(FEATURES, "y", SMALL, ["rf", "xgb"])
    few = rows.where("a < 9")
    mixed = {"xgb": fit_all({"xgb": (bases["xgb"], rows)})["xgb"], "rf": fit_all({"rf": (bases["rf"], few)})["rf"]}
    scalings.clear()
    together = add_predictions(mixed, rows)
    assert len(scalings) == 2 and sorted(together.collect()) == sorted(alone(mixed, rows).collect())
    assert add_predictions({}, rows).columns == rows.columns


def test_ensembles_take_models_that_were_fitted_elsewhere(rows, models, monkeypatch):
    bases = base_learners(FEATURES, "y", SMALL, ["rf"])
    outside, names = fold_fits(bases, rows)
    seen, more = holdout_fits(bases, rows, "key")
    parts = fit_all({**outside, **seen}, sets={**names, **more})
    assert sorted(parts, key=str) == [("part", "rf"), *[("rf", k) for k in range(5)]]
    fitted = {"rf": models["rf"]}
    own = [e.fit(rows) for e in (FoldStack(bases, FEATURES, "y", fitted=fitted), HoldoutBlend(bases, "key", "y", fitted=fitted))]
    monkeypatch.setattr(ensemble, "fit_all", None)
    given = [
        FoldStack(bases, FEATURES, "y", fitted=fitted, parts=parts).fit(rows),
        HoldoutBlend(bases, "key", "y", fitted=fitted, parts=parts).fit(rows),
    ]
    for a, b in zip(own, given):
        assert a.meta.coefficients.toArray() == pytest.approx(b.meta.coefficients.toArray(), abs=1e-4)


def test_a_study_fits_in_one_pool(rows, monkeypatch):
    pools = []
    monkeypatch.setattr(study, "fit_all", lambda jobs, *a: pools.append(len(jobs)) or fit_all(jobs, *a))
    monkeypatch.setattr(ensemble, "fit_all", None)
    found = study.run_study(rows.drop("fold"), "y", params=SMALL, key="key", repeats=1)
    assert pools == [4 * 7] and list(found.models) == ["xgb", "rf", "lgb", "et", "stack", "blend"]
