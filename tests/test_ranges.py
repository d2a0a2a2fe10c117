"""Ranks, carried values and recurrences over many ranges, against plain code."""

import datetime
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import features as X
from barloom.functions import ranges as R
from barloom.operators import integrate as I
from barloom.operators import series as S


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Else a few rows are one range."""
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    yield
    spark.conf.set(conf, before)


def day(n):
    return datetime.date(2020, 1, 1) + datetime.timedelta(days=n)


def test_a_group_and_a_value_are_many_ranges(spark):
    rows = R.ranged(spark.range(4000).select(F.lit(1).alias("g"), F.lit(2.0).alias("v"), "id"), ["g"], "v")
    sizes = [r["count"] for r in rows.groupBy("_range").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 1500


def ranked_rows(seed):
    draw = random.Random(seed)
    rows = [(draw.choice("aab"), draw.choice([1.0, 1.0, 1.0, draw.random(), None])) for _ in range(600)] + [(None, 3.0), (None, 3.0), ("z", 1.0), ("y", None)]
    return [(g, v, i) for i, (g, v) in enumerate(rows)]


@pytest.mark.parametrize("seed", range(4))
def test_average_rank(spark, seed):
    rows = ranked_rows(seed)
    df = spark.createDataFrame(rows, "g string, v double, i int")
    got = {r["i"]: r["v_rank"] for r in R.average_rank(df, "v", ["g"], "v_rank").collect()}
    p = pd.DataFrame(rows, columns=["g", "v", "i"])
    want = p.groupby("g", dropna=False)["v"].rank(pct=True)
    assert got.keys() == set(p["i"]) and all(math.isclose(got[i], w, rel_tol=1e-12) if not math.isnan(w) else got[i] is None for i, w in want.items())
    plain = {r["i"]: r["v"] for r in R.average_rank(df, "v", [], "v", share=False).collect()}
    assert all(math.isclose(plain[i], w) if not math.isnan(w) else plain[i] is None for i, w in p["v"].rank().items())
    assert R.average_rank(df.where("false"), "v", ["g"], "r").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_position(spark, seed):
    rows = [(g, v, i) for g, v, i in ranked_rows(seed) if v is not None]
    got = {r["i"]: (r["at"], r["n"]) for r in R.position(spark.createDataFrame(rows, "g string, v double, i int"), ["v", "i"], ["g"], "at", "n").collect()}
    for g in {r[0] for r in rows}:
        own = sorted((v, i) for k, v, i in rows if k == g)
        assert [got[i] for _, i in own] == [(n, len(own)) for n in range(1, len(own) + 1)]


@pytest.mark.parametrize("key", [[], ["k"]])
def test_asof_over_gaps_of_several_ranges(spark, key):
    draw = random.Random(4)
    observed = [(k, day(n), float(n)) for k in "ab" for n in [3, 4, 90, 400] for _ in range(2)] + [("a", day(4), 9.0), ("b", day(500), None)]
    asked = [(k, day(n)) for k in "abc" for n in sorted(draw.sample(range(600), 250))]
    seen, wanted = spark.createDataFrame(observed, "k string, Date date, v double"), spark.createDataFrame(asked, "k string, Date date")
    mine = lambda k: [o for o in observed if not key or o[0] == k]

    def last(k, d):
        return max(((o[1], o[2]) for o in mine(k) if o[2] is not None and o[1] <= d), default=(None, None))

    got = sorted(map(tuple, I.asof_latest(wanted, seen, "v", key=key).collect()), key=str)
    assert got == sorted((((k, d, last(k, d)[1]) if key else (d, last(k, d)[1])) for k, d in asked), key=str)
    got = sorted(map(tuple, I.asof_with_tolerance(wanted, seen.where("v is not null"), "v", days=5, default=-1.0, key=key).collect()), key=str)
    near = lambda k, d: last(k, d)[1] if last(k, d)[0] and (d - last(k, d)[0]).days <= 5 else -1.0
    assert got == sorted((((k, d, near(k, d)) if key else (d, near(k, d))) for k, d in asked), key=str)


def test_one_long_series_is_many_ranges(spark):
    rng = np.random.default_rng(2)
    prices = np.round(np.cumsum(rng.normal(0, 1, 5000)) + 500, 3)
    holes = set(rng.choice(5000, 300, replace=False).tolist())
    xs = [None if i in holes else float(x) for i, x in enumerate(prices)]
    df = spark.createDataFrame([("only", day(i), x) for i, x in enumerate(xs)], "Company string, Date date, px double")
    assert R.ranged(df, ["Company"], "Date").select("_range").distinct().count() > 4
    p = pd.Series(xs, dtype="f8")
    move = p.diff()
    gain, loss = (x.clip(lower=0.0).ewm(alpha=1 / 14, ignore_na=True).mean() for x in (move, -move))
    want = (100 - 100 / (1 + gain / loss.where(loss != 0, 1e-9))).where(move.notna().cumsum() >= 14, 50.0)
    assert np.allclose([r["rsi"] for r in X.rsi(df, "px").orderBy("Date").collect()], want, rtol=1e-10)
    mean = lambda x, span: x.ewm(span=span, adjust=False, ignore_na=True).mean()
    line = mean(p, 12) - mean(p, 26)
    got = X.macd(df, "px").orderBy("Date").collect()
    assert np.allclose([r["macd"] for r in got], line.fillna(0.0), atol=1e-8) and np.allclose([r["macd_signal"] for r in got], mean(line, 9).fillna(0.0), atol=1e-8)


def test_long_viterbi_against_a_loop(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, np.where(np.arange(3000) // 200 % 2, 3.0, 1.0))
    mean, var, stay = [0.0, 0.1], [1.0, 9.0], [0.97, 0.95]
    emit = -0.5 * (np.log(2 * np.pi * np.array(var)) + (x[:, None] - mean) ** 2 / np.array(var))
    moves = np.log([[stay[0], 1 - stay[0]], [1 - stay[1], stay[1]]])
    scores, came = np.log(0.5) + emit[0], []
    for e in emit[1:]:
        came.append((scores[:, None] + moves).argmax(axis=0))
        scores = (scores[:, None] + moves).max(axis=0) + e
    path = [int(scores.argmax())]
    for c in reversed(came):
        path.append(int(c[path[-1]]))
    df = spark.createDataFrame([(s, day(i), float(v)) for s in ("one", None) for i, v in enumerate(x)], "series string, Date date, value double")
    for s in ("one", None):
        got = [r["state"] for r in S.viterbi(df, mean, var, stay).where(F.col("series").eqNullSafe(s)).orderBy("Date").collect()]
        assert got == path[::-1]


def test_ranges_are_as_many_as_the_rows_ask_for(spark):
    """Whatever the shuffle partitions: a task's share does not grow with the input, and the ranks stay whole."""
    from barloom.functions import ranges

    df = spark.range(40_000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 1000).cast("double").alias("v"))
    per = [r["count"] for r in ranges.ranged(df, ["g"], "v", rows=1000).groupBy("_range").count().collect()]
    assert len(per) >= 36 and max(per) < 2500 and sum(per) == 40_000
    assert df.rdd.getNumPartitions() <= 8


def test_a_recurrence_deals_many_series_to_a_group(spark, monkeypatch):
    """Series that fit a range and series over several, in ranges of a few rows; the calls of Python follow the ranges, not the series."""
    from barloom.functions import features, scan

    monkeypatch.setattr(scan, "STEPS", 40)
    rows = [(k, datetime.date(2020, 1, 1) + datetime.timedelta(days=i), float((i * 37 + k * 11) % 50)) for k in range(60) for i in range(150 if k < 2 else 3)]
    df = spark.createDataFrame(rows, "Company int, Date date, px double")
    few = {(r["Company"], r["Date"]): (r["macd"], r["macd_signal"]) for r in features.macd(df, "px").collect()}
    monkeypatch.setattr(scan, "STEPS", 10**6)
    one = {(r["Company"], r["Date"]): (r["macd"], r["macd_signal"]) for r in features.macd(df, "px").collect()}
    assert len(few) == len(rows) == len(one)
    assert all(abs(few[k][i] - one[k][i]) < 1e-9 for k in one for i in (0, 1))
    plan = features.macd(df, "px")._jdf.queryExecution().toString()
    assert "flatmapgroupsinarrow [_b" in plan.lower() and "flatmapgroupsinarrow [key" not in plan.lower()
