"""Registered queries do the whole job: no rows left out."""

import pytest

from barloom import queries as core
from barloom.operators import walk_forward as W
from barloom.plans import queries_evaluate as Q

DIRECTORY = "/root/testdata/sf0.001"


def test_mlp_predicts_every_row_of_its_fold(spark):
    got = core.queries()["f11_mlp_classifier"](spark, DIRECTORY).select("Company", "Date")
    folds = W.Folds(Q._labelled(spark, DIRECTORY))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, folds.test(folds.folds[-1]).select("Company", "Date").collect()))


def test_models_are_not_the_small_ones(spark, monkeypatch):
    class Asked(Exception):
        pass

    def asked(**given):
        raise Asked(given)

    monkeypatch.setattr(Q.E, "models", asked)
    for name in ("RandomForestClassifier", "MLPClassifier", "RandomForest", "GradientBoosting"):
        with pytest.raises(Asked) as e:
            Q._scored(name)(spark, DIRECTORY)
        assert not e.value.args[0].get("small")


def test_hmm_has_every_month_end(spark):
    got = core.queries()["g6_fit_hmm"](spark, DIRECTORY).selectExpr("month(asof) AS m").distinct()
    assert sorted(r["m"] for r in got.collect()) == list(range(1, 13))
