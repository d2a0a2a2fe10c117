"""Walk-forward folds and models: nothing is predicted by what saw it, ridge against plain solvers, stored graphs that follow their input."""

import datetime
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import evaluate as E
from barloom.operators import walk_forward as W
from barloom.plans import queries_evaluate as Q
from barloom.plans import queries_graph, views
from barloom.queries import queries

DIRECTORY = "/root/testdata/sf0.001"


def day(n):
    return datetime.date(2020, 1, 1) + datetime.timedelta(days=n)


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(1)
    made = []
    for i in range(1200):
        a, b = draw.gauss(100, 5), draw.gauss(0, 1)
        made.append((i % 10, day(i // 10 * 3), a, b, 7.0, None if i % 50 == 0 else draw.random(), 0.3 * b + 0.02 * a + draw.gauss(0, 0.2)))
    return spark.createDataFrame(made, "Company long, Date date, a double, b double, constant double, gap double, truth double").cache()


def test_folds_are_the_surveyed_ones_and_keep_the_embargo(spark, rows):
    folds = W.Folds(rows, 5, 30, 50)
    assert [f.number for f in folds.folds] == [1, 2, 3, 4, 5]
    for f in folds.folds:
        last, first = folds.train(f).agg(F.max("Date")).first()[0], folds.test(f).agg(F.min("Date")).first()[0]
        assert last == f.train_end and (first - last).days >= 30
    mine = [(f.number, side, r["Company"], r["Date"]) for f in folds.folds for side, part in (("train", folds.train(f)), ("test", folds.test(f))) for r in part.collect()]
    theirs = [(r["fold"], r["side"], r["Company"], r["Date"]) for r in E.walk_forward_folds(rows, 5, 30, 50).collect()]
    assert sorted(mine) == sorted(theirs)
    assert W.Folds(rows.limit(0)).folds == [] and W.Folds(rows, least=10_000).folds == []
    with pytest.raises(ValueError):
        W.predictions(W.Folds(rows.limit(0)), {"x": ["a"]}, {}, ["Date"])


def test_ridge_against_leaving_each_row_out(spark, rows):
    folds = W.Folds(rows, 2, 30, 50)
    sets = {"one": ["b"], "all": ["a", "b", "constant", "gap"]}
    found = {(r["fold"], r["feature_set"]): r for r in W.ridge(folds, sets, "truth")}
    assert len(found) == 4
    f = folds.folds[0]
    part = folds.train(f).fillna(0.0).collect()
    y = np.array([r["truth"] for r in part])
    for name, columns in sets.items():
        x = np.array([[r[c] for c in columns] for r in part])
        deviation = x.std(axis=0)
        z = (x - x.mean(axis=0)) / np.where(deviation > 1e-12, deviation, 1)

        def solved(z, y, penalty):
            m = z.mean(axis=0)
            w = np.linalg.solve((z - m).T @ (z - m) + penalty * np.eye(z.shape[1]), (z - m).T @ (y - y.mean()))
            return w, y.mean() - w @ m

        errors = []
        for penalty in W.PENALTIES:
            left = []
            for i in range(len(y)):
                keep = np.arange(len(y)) != i
                w, c = solved(z[keep], y[keep], penalty)
                left.append((y[i] - c - z[i] @ w) ** 2)
            errors.append(np.mean(left))
        r = found[f.number, name]
        assert r["penalty"] == W.PENALTIES[int(np.argmin(errors))] and abs(r["error"] - min(errors)) < 1e-9
        w, c = solved(z, y, r["penalty"])
        pred = W.ridge_predictions(folds, {name: columns}, "truth", ["Company", "Date"]).where(F.col("fold") == f.number).collect()
        want = {(t["Company"], t["Date"]): c + ((np.array([t[k] for k in columns]) - x.mean(axis=0)) / np.where(deviation > 1e-12, deviation, 1)) @ w for t in folds.test(f).fillna(0.0).collect()}
        assert len(pred) == len(want) and all(abs(want[p["Company"], p["Date"]] - p["pred"]) < 1e-9 for p in pred)


def test_no_model_sees_what_it_predicts(spark, rows):
    """Labels that only memory could know: a deep forest on the row's own number recalls its training rows, and none of the test rows."""
    from pyspark.ml.regression import RandomForestRegressor

    noisy = rows.withColumn("own", F.unix_date("Date") * 10.0 + F.col("Company")).withColumn("label", F.pmod(F.xxhash64("Company", "Date"), F.lit(1000)) / 1000)
    folds = W.Folds(noisy, 3, 30, 50)
    forest = RandomForestRegressor(labelCol="label", numTrees=5, maxDepth=14, maxBins=512, seed=1)
    out = W.predictions(folds, {"own": ["own"], "two": ["own", "a"]}, {"forest": forest}, ["Company", "Date", "label"])
    assert out.groupBy("fold", "feature_set").count().count() == 6
    assert out.where("feature_set = 'own'").count() == sum(folds.test(f).count() for f in folds.folds)
    assert abs(out.agg(F.corr("pred", "label")).first()[0]) < 0.2


def test_scaling_is_learnt_from_training_rows(spark, rows):
    from pyspark.ml.regression import LinearRegression

    folds = W.Folds(rows.withColumn("label", F.col("truth")), 3, 30, 50)
    plain, scaled = (W.predictions(folds, {"x": ["a", "b"]}, {"lr": LinearRegression(labelCol="label")}, ["Company", "Date"], scaled=s).orderBy("fold", "Company", "Date").collect() for s in (False, True))
    assert [r["pred"] for r in plain] == pytest.approx([r["pred"] for r in scaled])


def test_stack_learns_from_earlier_folds(spark):
    draw = random.Random(2)
    made = [(fold, "both", i, m, t + draw.gauss(0, s) if m == "good" else draw.random(), t) for fold in (1, 2, 3) for i in range(60) for t in [draw.random()] for m, s in (("good", 0.05), ("bad", 0))]
    oof = spark.createDataFrame(made, "fold int, feature_set string, i int, model string, pred double, truth double")
    got = {(r["fold"], r["i"]): r["pred"] for r in W.stacked(oof, ["i"], "truth", ["bad", "good"]).collect()}
    by = {(f, i, m): p for f, _, i, m, p, _ in made}
    truth = {(f, i): t for f, _, i, _, _, t in made}
    assert len(got) == 180 and all(abs(got[1, i] - (by[1, i, "bad"] + by[1, i, "good"]) / 2) < 1e-12 for i in range(60))
    past = [(f, i) for f in (1, 2) for i in range(60)]
    x, y = np.array([[by[f, i, m] for m in ("bad", "good")] for f, i in past]), np.array([truth[k] for k in past])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    near = []
    for penalty in W.STACK_PENALTIES:
        w = np.linalg.solve(z.T @ z + penalty * np.eye(2), z.T @ (y - y.mean()))
        pred = [y.mean() + ((np.array([by[3, i, m] for m in ("bad", "good")]) - x.mean(axis=0)) / x.std(axis=0)) @ w for i in range(60)]
        near.append(max(abs(p - got[3, i]) for i, p in enumerate(pred)))
    assert min(near) < 1e-9


def test_a_model_is_rejected(spark):
    """On the given rows the third model is like one that was admitted, so the vote of f18 is not that of f17."""
    sf = "/root/testdata/sf0.01"
    picked = E.diverse_select(Q._ic(spark, sf), E.oof_correlation(Q._oof(spark, sf), ["fold", "Company", "Date"], Q.MODELS))
    assert 1 <= len(picked) < len(Q.MODELS)


def test_stored_tables_follow_their_input(spark, tmp_path):
    here = str(tmp_path / "in")
    shutil.copytree(DIRECTORY, here)
    before = queries()["e6_graph_size"](spark, here).agg(F.sum("n")).first()[0]
    few = spark.read.parquet(f"{here}/supplier.parquet").limit(3).toPandas()
    few.to_parquet(f"{here}/supplier.parquet")
    after = queries()["e6_graph_size"](spark, here).agg(F.sum("n")).first()[0]
    fresh = shutil.copytree(here, str(tmp_path / "copy"))
    assert after < before and after == queries()["e6_graph_size"](spark, fresh).agg(F.sum("n")).first()[0]
    wide = {r["c"] for r in queries()["e8_match"](spark, here).collect()}
    assert len(wide) <= 3
    queries_graph.STORED.clear()
    assert queries()["e6_graph_size"](spark, here).agg(F.sum("n")).first()[0] == after
    for _, table in list(queries_graph.STORED._held.values()):
        shutil.rmtree(table._written.removeprefix("file://"))  # somebody clears the shared folder
    assert queries()["e6_graph_size"](spark, here).agg(F.sum("n")).first()[0] == after
    assert views.table(spark, here, "supplier").count() == 3


def test_columns_of_models_give_what_rows_of_models_give(spark):
    """The truth is ranked once for all models, and a correlation moves no rows."""
    rng = np.random.default_rng(4)
    rows = [(i % 3, i, float(t), float(round(t + a, 2)), float(round(b, 1)), 1.0) for i, (t, a, b) in enumerate(rng.normal(0, 1, (900, 3)))]
    wide = spark.createDataFrame(rows, "fold int, Company int, truth double, `M/a` double, `M/b` double, `M/c` double")
    names = ["M/a", "M/b", "M/c"]
    oof = E.oof_table(wide, ["fold", "Company"], names, "truth")
    want = {(r["model"], r["fold"]): r["ic"] for r in E.rank_ic(oof, ["model", "fold"]).collect()}
    got = {(r["model"], r["fold"]): r["ic"] for r in E.rank_ic_of(wide, ["fold"], names).collect()}
    assert got.keys() == want.keys() and all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-12) for k in want)
    assert want["M/c", 0] is None
    pair = E.correlations(wide, names[:2])
    assert abs(pair.first()["corr"] - E.oof_correlation(oof, ["fold", "Company"], names[:2]).first()["corr"]) < 1e-12
    assert "hashpartitioning" not in pair._jdf.queryExecution().executedPlan().toString()
