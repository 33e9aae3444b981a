"""Queries that fit learners do so at full size; nothing is fitted here."""

from unittest.mock import MagicMock

import pytest

from varve.operators import importance
from varve.plans import queries


class Asked(Exception):
    pass


@pytest.fixture(autouse=True)
def no_tables(monkeypatch):
    monkeypatch.setattr(queries.fixtures, "training_table", MagicMock())
    monkeypatch.setattr(queries.fixtures, "study_rows", MagicMock())
    monkeypatch.setattr(queries, "new_path", MagicMock())


@pytest.mark.parametrize("name", ["stacking", "stacking_without_features", "blending", "permutation_importance_learners"])
def test_learners_are_full_size(monkeypatch, name):
    def asked(features, target, params, *names):
        raise Asked(params, names)

    monkeypatch.setattr(queries, "base_learners", asked)
    with pytest.raises(Asked) as found:
        queries.QUERIES[name](MagicMock(), "")
    assert found.value.args == (queries.LEARNERS, ())


def test_randomised_trees_alone_have_their_published_size(monkeypatch):
    found = {}

    def asked(features, target, params, names):
        found.update(params[names[0]])
        raise Asked

    monkeypatch.setattr(queries, "base_learners", asked)
    with pytest.raises(Asked):
        queries.QUERIES["learner_extra_trees"](MagicMock(), "")
    assert found == {"n_estimators": 100, "max_depth": 15}


def test_permutations_repeat_twenty_times(monkeypatch):
    found = {}

    def permuted(*_, repeats=importance.REPEATS, **__):
        found["importance"] = repeats
        return MagicMock()

    def studied(*_, params, repeats, **__):
        found["study"] = params, repeats

    monkeypatch.setattr(queries, "base_learners", lambda *_: {})
    monkeypatch.setattr(queries, "fit_all", lambda models: {})
    monkeypatch.setattr(queries.importance, "permutation_importance", permuted)
    monkeypatch.setattr(queries, "run_study", studied)
    monkeypatch.setattr(queries, "F", MagicMock())
    queries.permutation_importance_learners(MagicMock(), "")
    queries._study(MagicMock(), "nowhere")
    assert found == {"importance": 20, "study": (queries.LEARNERS, 20)}
