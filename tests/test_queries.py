"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import normal
from varve.plans.oracles import ORACLES
from varve.plans.queries import QUERIES

# These fit many models; check.py runs them at a larger scale.
SLOW = {
    "base_predictions", "oof_predictions", "stacking", "stacking_without_features", "blending", "loaded_scoring",
    "study_report", "study_tables", "rescore_report", "ensemble_score", "learner_extra_trees", "learner_gbt_bagged",
    "model_roundtrip", "impurity_importance", "permutation_importance_learners", "cv_search",
}


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query_equals_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    got = con.sql(entry.oracle_sql()[name])
    have = normal(df.columns, df.collect())
    want = normal(got.columns, got.fetchall())
    assert len(have[1]) > 0
    assert have == want


def test_entry_reports_each_model_and_split(spark):
    out = entry.entry(spark)
    assert out.columns == ["model", "split", "n", "n_missing", "r2", "mae", "mse", "medae", "rmse", "mape"]
    found = {(r["model"], r["split"]): r for r in out.collect()}
    assert len(found) == 14 and found[("exact", "test")]["r2"] == 1.0 and found[("rf", "test")]["r2"] > 0.9
