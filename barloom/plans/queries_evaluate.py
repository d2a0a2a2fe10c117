"""Queries of model data and evaluation (f) and of time series (g), each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import features as X
from barloom.operators import evaluate as E
from barloom.operators import forest as T
from barloom.operators import integrate as I
from barloom.operators import networks as N
from barloom.operators import series as S
from barloom.operators import walk_forward as W
from barloom.plans import views as V
from barloom.plans.queries_base import FILLED
from barloom.plans.views import oracle
from barloom.sources.scratch import Stored

R = lambda c, n=6: F.round(c, n)
NAMES = ["m1", "m2", "m3"]
FEATURES = {"embedding": ["e1", "e2", "e3"], "tabular": NAMES, "tabular+embedding": [*NAMES, "e1", "e2", "e3"]}
MODELS = [f"Ridge/{name}" for name in FEATURES]
KEEP = ["Company", "Date", "ret", "truth"]
#: Out-of-fold predictions, which many queries read: written once for a version of their input.
STORED = Stored()
ROW_RANK = "(rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0) / count(*) OVER (PARTITION BY {by})"


DAYS = "SELECT Date, least(floor((row_number() OVER (ORDER BY Date) - 1) / greatest(floor(count(*) OVER () / 6), 1)), 5)::int AS block FROM (SELECT DISTINCT Date FROM scores)"
CUTS = "SELECT a.block + 1 AS fold, a.e AS train_end, b.e AS test_end FROM (SELECT block, max(Date) AS e FROM days GROUP BY block) a JOIN (SELECT block, max(Date) AS e FROM days GROUP BY block) b ON b.block = a.block + 1"
SIDES = "SELECT s.*, fold, CASE WHEN Date <= train_end THEN 'train' ELSE 'test' END AS side FROM model_rows s JOIN cuts ON Date <= train_end OR (Date >= train_end + 30 AND Date <= test_end)"
GOOD = "SELECT fold FROM sides GROUP BY fold HAVING count(*) FILTER (side = 'train') >= 100 AND count(*) FILTER (side = 'test') >= 100"
TEST = "SELECT * EXCLUDE (side) FROM sides WHERE side = 'test' AND fold IN (SELECT fold FROM good)"
#: A ridge by fold, feature set and penalty: standardised rows, their products, the inverse by elimination, and the leave-one-out errors.
RIDGE = {
    "rr_sets": "SELECT * FROM (VALUES ('tabular', [1, 2, 3]), ('embedding', [4, 5, 6]), ('tabular+embedding', [1, 2, 3, 4, 5, 6])) t(feature_set, cols)",
    "rr_learn": "SELECT row_number() OVER () AS id, fold, truth AS y, [m1, m2, m3, e1, e2, e3] AS v FROM sides WHERE side = 'train' AND fold IN (SELECT fold FROM good)",
    "rr_stat": "SELECT fold, list(mu ORDER BY i) AS mu, list(sd ORDER BY i) AS sd FROM (SELECT fold, i, avg(v[i]) AS mu, CASE WHEN stddev_pop(v[i]) > 1e-12 THEN stddev_pop(v[i]) ELSE 1 END AS sd FROM rr_learn CROSS JOIN (SELECT unnest(range(1, 7)) AS i) GROUP BY fold, i) GROUP BY fold",
    "rr_level": "SELECT fold, count(*) AS n, avg(y) AS level FROM rr_learn GROUP BY fold",
    "rr_scaled": "SELECT id, fold, y - level AS y, n, list_transform(range(1, 7), lambda i: (v[i] - mu[i]) / sd[i]) AS z FROM rr_learn JOIN rr_stat USING (fold) JOIN rr_level USING (fold)",
    "rr_gram": "SELECT fold, list(g ORDER BY i) AS g, list(b ORDER BY i) AS b FROM (SELECT fold, i, list(g ORDER BY j) AS g, any_value(b) AS b FROM (SELECT fold, i, j, sum(z[i] * z[j]) AS g, sum(z[i] * y) AS b FROM rr_scaled CROSS JOIN (SELECT unnest(range(1, 7)) AS i) CROSS JOIN (SELECT unnest(range(1, 7)) AS j) GROUP BY fold, i, j) GROUP BY fold, i) GROUP BY fold",
    "rr_solve": """SELECT fold, feature_set, cols, penalty, len(cols) AS p, 0::bigint AS k, list_transform(cols, lambda a: list_concat(list_transform(cols, lambda c: g[a][c] + CASE WHEN a = c THEN penalty ELSE 0 END), list_transform(cols, lambda c: CASE WHEN a = c THEN 1.0::double ELSE 0.0::double END))) AS m
 FROM rr_gram CROSS JOIN rr_sets CROSS JOIN (SELECT unnest([0.01, 0.1, 1, 10, 100, 1000]::double[]) AS penalty)
 UNION ALL SELECT fold, feature_set, cols, penalty, p, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda x: x / m[k + 1][k + 1]) ELSE list_transform(r, lambda x, c: x - r[k + 1] * m[k + 1][c] / m[k + 1][k + 1]) END) FROM rr_solve WHERE k < p""",
    "rr_inverse": "SELECT s.fold, feature_set, cols, penalty, list_transform(m, lambda r: r[p + 1 : 2 * p]) AS inv, list_transform(m, lambda r: list_inner_product(r[p + 1 : 2 * p], list_transform(cols, lambda a: b[a]))) AS w FROM rr_solve s JOIN rr_gram USING (fold) WHERE k = p",
    "rr_left": "SELECT fold, feature_set, penalty, avg(pow((y - list_inner_product(u, w)) / greatest(1 - 1.0 / n - list_inner_product(u, list_transform(inv, lambda r: list_inner_product(r, u))), 1e-9), 2)) AS error FROM (SELECT fold, feature_set, penalty, y, n, w, inv, list_transform(cols, lambda a: z[a]) AS u FROM rr_scaled JOIN rr_inverse USING (fold)) GROUP BY fold, feature_set, penalty",
    "rr_best": "SELECT fold, feature_set, cols, penalty, error, w FROM rr_inverse JOIN rr_left USING (fold, feature_set, penalty) QUALIFY row_number() OVER (PARTITION BY fold, feature_set ORDER BY round(error, 12), penalty) = 1",
    "oof": "SELECT fold, Company, Date, ret, truth, 'Ridge/' || feature_set AS model, round(level + list_sum(list_transform(w, lambda x, i: x * ([m1, m2, m3, e1, e2, e3][cols[i]] - mu[cols[i]]) / sd[cols[i]])), 9) AS pred FROM tests JOIN rr_best USING (fold) JOIN rr_stat USING (fold) JOIN rr_level USING (fold)",
}


def _folds(s, d):
    return W.Folds(V.model_rows(s, d))


def _wide(s, d):
    """Ridge over three feature sets: what the past of each fold says of its rows, a column for each model."""
    rows = V.model_rows(s, d)

    def make():
        folds = W.Folds(rows)
        out = W.ridge_columns(folds, FEATURES, "truth", KEEP)
        return out.select("fold", *KEEP, *(R(f"`{name}`", 9).alias(model) for name, model in zip(FEATURES, MODELS, strict=True)))

    return STORED.get("oof", d, rows, make)


def _oof(s, d):
    """The same with a row for each model."""
    return E.oof_table(_wide(s, d), ["fold", *KEEP[:-1]], MODELS, KEEP[-1])


def _ic(s, d):
    """By model and fold: a few rows, which several queries read more than once."""
    wide = _wide(s, d)
    return STORED.get("ic", d, wide, lambda: E.rank_ic_of(wide, ["fold"], MODELS))


IC = f"SELECT model, fold, CASE WHEN count(*) >= 10 AND stddev_pop(p) > 0 AND stddev_pop(t) > 0 THEN corr(p, t) END AS ic FROM (SELECT model, fold, {ROW_RANK.format(by='model, fold', c='pred')} AS p, {ROW_RANK.format(by='model, fold', c='truth')} AS t FROM oof) GROUP BY model, fold"


def _rounded(df, *keep):
    return df.select(*keep, *(R(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes if c not in keep))


def _f2(s, d, pop=False):
    w = V.bars(s, d).select("Company", "Date", F.col("Close").alias("px"))
    return w.select("Company", "Date", R(E.zscore_by_date("px", population=pop)).alias("z"))


def _model_rows(s, d):
    rows = V.scores(s, d).withColumns({"label": F.col("truth"), "up": (F.col("truth") > 0.5).cast("double")})
    # the last tenth of the rows by date is the validation set of the boosted trees
    rows = E.temporal_split(rows, 0.9).withColumn("validation", F.col("side") == "test").drop("side")
    return E.spread(E.assemble(rows, NAMES))


def _labelled(s, d):
    return V.model_rows(s, d).withColumns({"label": F.col("truth"), "up": (F.col("truth") > 0.5).cast("double")})


BOTH = {"tabular+embedding": FEATURES["tabular+embedding"]}


def _scored(name, label="label"):
    """The last fold, which learns from most rows: what a model of both feature sets says of the rows that it did not see."""

    def run(s, d):
        est = E.models(label=label)[name]
        folds = W.Folds(_labelled(s, d))
        out = W.predictions(folds, BOTH, {name: est}, ["Company", "Date"], only=folds.folds[-1:])
        return out.select("fold", "Company", "Date", R("pred", 4).alias("prediction"))

    return run


def _forest(depth, tried, label="label", classify=False):
    """The same of a forest."""

    def run(s, d):
        folds = W.Folds(_labelled(s, d))
        out = T.forest_predictions(folds, BOTH["tabular+embedding"], label, ["Company", "Date"], depth, tried, classify=classify, only=folds.folds[-1:])
        return out.select("fold", "Company", "Date", R("pred", 4).alias("prediction"))

    return run


def _f11(s, d):
    folds = W.Folds(_labelled(s, d))
    out = N.perceptron_predictions(folds, BOTH["tabular+embedding"], "up", ["Company", "Date"], E.HIDDEN, only=folds.folds[-1:])
    return out.select("fold", "Company", "Date", R("pred", 4).alias("prediction"))


def _f4(s, d):
    rows = _model_rows(s, d)
    scaled = E.standard_scale(rows.where("Date < date '1998-01-01'"), rows)[1]
    from pyspark.ml.functions import vector_to_array

    return scaled.select("Company", "Date", R(F.element_at(vector_to_array("scaled"), 1), 4).alias("z"))


def _f7(s, d):
    rows = _labelled(s, d)
    scores = N.grid_search(W.Folds(rows, 3, 0, 1), FEATURES["tabular+embedding"], "up")
    return _rounded(N.best_cell(scores), "hidden", "activation", "penalty", "rate", "best")


def _f8(s, d):
    from pyspark.ml.functions import vector_to_array

    return E.one_hot(V.companies(s, d).na.fill("none", ["Sector"]), ["Sector"]).select("Symbol", F.array_join(F.transform(vector_to_array("Sector_vec"), lambda x: x.cast("int").cast("string")), "").alias("code"))


def _f9(s, d):
    rows = V.scores(s, d).select((F.col("truth") > 0.9).cast("int").alias("label"), F.array(*NAMES).alias("features"))
    return E.oversample_minority(rows, "label").groupBy("label").agg(F.count("*").alias("n"))


def _f12(s, d):
    found = [(r["fold"], r["feature_set"], r["penalty"], r["error"]) for r in W.ridge(_folds(s, d), FEATURES, "truth")]
    return s.createDataFrame(found, "fold int, feature_set string, penalty double, error double").select("fold", "feature_set", "penalty", R("error", 9).alias("error"))


def _f16(s, d):
    oof = W.predictions(W.Folds(_labelled(s, d)), BOTH, W.boosted(), KEEP)
    return W.stacked(oof, ["Company", "Date", "ret"], "truth", list(W.boosted())).select("fold", "Company", "Date", R("pred", 4).alias("prediction"))


def _f18(s, d):
    picked = E.diverse_select(_ic(s, d), E.correlations(_wide(s, d), MODELS))
    voted = E.soft_vote(_oof(s, d).where(F.col("model").isin(picked)), ["fold", "Company", "Date"], ["fold"])
    return voted.select("fold", "Company", "Date", R("pred").alias("pred"))


VOTE = f"SELECT fold, Company, Date, round({ROW_RANK.format(by='fold', c='v')}, 6) AS pred FROM (SELECT fold, Company, Date, round(avg(r), 9) AS v FROM (SELECT fold, Company, Date, {ROW_RANK.format(by='model, fold', c='pred')} AS r FROM oof) GROUP BY fold, Company, Date)"


#: Of three models in order of falling ic: the first, the second if it is not too like it, the third if it is not too like those.
PICKED = {
    "alike": "SELECT x.model AS a, y.model AS b, abs(corr(x.pred, y.pred)) > 0.85 AS close FROM oof x JOIN oof y USING (fold, Company, Date) WHERE x.model <> y.model GROUP BY ALL",
    "by_ic": "SELECT model, row_number() OVER (ORDER BY avg(ic) DESC, model) AS n FROM ic GROUP BY model",
    "second": "SELECT model FROM by_ic m WHERE n = 2 AND NOT (SELECT bool_or(close) FROM alike WHERE a = m.model AND b IN (SELECT model FROM by_ic WHERE n = 1))",
    "picked": "SELECT model FROM by_ic WHERE n = 1 UNION ALL SELECT model FROM second UNION ALL SELECT model FROM by_ic m WHERE n = 3 AND NOT (SELECT bool_or(close) FROM alike WHERE a = m.model AND b IN (SELECT model FROM by_ic WHERE n = 1 UNION ALL SELECT model FROM second))",
}


def _f24(s, d):
    return _rounded(E.decile_spread(_oof(s, d), ["model", "fold"]), "model", "fold")


F24 = """SELECT model, fold, round(avg(sp), 6) AS spread, count(*) AS n_dates FROM (SELECT model, fold, Date, max_by(m, bin) - min_by(m, bin) AS sp FROM (SELECT model, fold, Date, bin, avg(ret) AS m FROM
 (SELECT o.model, o.fold, o.Date, o.ret, greatest(len(list_filter(e, lambda x: x < pred)), 1) AS bin FROM oof o JOIN (SELECT model, fold, Date, list_distinct(quantile_cont(pred, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM oof GROUP BY ALL HAVING count(*) >= 10) q USING (model, fold, Date) WHERE len(e) > 1)
 GROUP BY ALL) GROUP BY ALL HAVING count(*) > 1) GROUP BY model, fold"""
F25 = "SELECT model, fold, round(avg(ret) FILTER (pos > n - k) - avg(ret) FILTER (pos <= k), 6) AS spread FROM (SELECT *, greatest(floor(n / 10), 1) AS k FROM (SELECT *, row_number() OVER (PARTITION BY model, fold ORDER BY pred, Date, Company) AS pos, count(*) OVER (PARTITION BY model, fold) AS n FROM oof)) WHERE n >= 20 GROUP BY model, fold"
SIGN = "SELECT model, count(ic) AS n, count(*) FILTER (ic > 0) AS positive, round((SELECT sum(gamma(a.n0 + 1) / (gamma(i + 1) * gamma(a.n0 - i + 1))) FROM (SELECT unnest(range(a.k0, a.n0 + 1)) AS i)) / pow(2, a.n0), 6) AS p FROM ic JOIN (SELECT model, count(ic)::int AS n0, count(*) FILTER (ic > 0)::int AS k0 FROM ic GROUP BY model) a USING (model) GROUP BY model, a.n0, a.k0"


def _f27(s, d):
    return _rounded(E.sign_test(_ic(s, d), ["model"], "ic"), "model")


def _f28(s, d):
    return _rounded(E.paired_comparison(_ic(s, d), "fold", "model", "ic"), "a", "b")


F28 = """SELECT a, b, n, round(md, 6) AS mean_difference, round(CASE WHEN m = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(gamma(m + 1) / (gamma(i + 1) * gamma(m - i + 1))) FROM (SELECT unnest(range(k, m + 1)) AS i)) / pow(2, m)) END, 6) AS p FROM
 (SELECT x.model AS a, y.model AS b, count(*) AS n, avg(x.ic - y.ic) AS md, greatest(count(*) FILTER (x.ic > y.ic), count(*) FILTER (x.ic < y.ic))::int AS k, count(*) FILTER (x.ic <> y.ic)::int AS m FROM ic x JOIN ic y ON x.fold = y.fold AND x.model < y.model GROUP BY ALL)"""


BOOT = """SELECT model, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM (SELECT model, b, avg(v[1 + ('0x' || substr(md5(b || ':' || i || ':0'), 1, 8))::bigint % len(v)]) AS m
 FROM (SELECT model, list_sort(list(ic)) AS v FROM ic WHERE ic IS NOT NULL GROUP BY model) CROSS JOIN (SELECT unnest(range(1, 10001)) AS b) CROSS JOIN LATERAL (SELECT unnest(range(0, len(v))) AS i) GROUP BY model, b) GROUP BY model"""


def _f29(s, d):
    return _rounded(E.bootstrap_ci(_ic(s, d), ["model"], "ic"), "model")


def _f30(s, d):
    ci = E.bootstrap_ci(_ic(s, d), ["model"], "ic").join(E.sign_test(_ic(s, d), ["model"], "ic"), "model")
    return E.flag_significant(ci).select("model", "significant")


def _f30b(s, d):
    return _rounded(E.best_per_group(_ic(s, d), ["fold"], "model", "ic"), "fold")


def _calls(s, d):
    return _oof(s, d).withColumns({"label": (F.col("truth") > 0.5).cast("int"), "pred": (F.col("pred") > 0.5).cast("int")})


def _f32(s, d):
    return _rounded(E.classification_report(_calls(s, d)))


F32 = """SELECT *, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM
 (SELECT count(*) FILTER (truth > 0.5 AND pred > 0.5) AS tp, count(*) FILTER (truth <= 0.5 AND pred > 0.5) AS fp, count(*) FILTER (truth <= 0.5 AND pred <= 0.5) AS tn, count(*) FILTER (truth > 0.5 AND pred <= 0.5) AS fn FROM oof)"""


def _series(s, d):
    return S.series_set(V.index_series(s, d), V.fx(s, d), X.first_value_per_date(V.bars(s, d), "Close", "Company"))


IDX = "SELECT Date, px, px / lag(px) OVER (ORDER BY Date) - 1 AS ret FROM index_series"
SERIES = """SELECT 'level' AS series, Date, px AS value FROM idx UNION ALL SELECT 'return_pct', Date, ret * 100 FROM idx WHERE ret IS NOT NULL
 UNION ALL SELECT 'volatility_pct', Date, v * 100 FROM (SELECT Date, CASE WHEN count(ret) OVER f >= 20 THEN stddev_samp(ret) OVER f END AS v FROM idx WINDOW f AS (ORDER BY Date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WHERE v IS NOT NULL
 UNION ALL SELECT 'EUR', Date, EUR FROM fx UNION ALL SELECT 'JPY', Date, JPY FROM fx UNION ALL SELECT 'first_close', Date, min_by(Close, Company) FROM bars GROUP BY Date"""


def _g2(s, d):
    best = S.best_order(S.arima_grid(_series(s, d)))
    return best.select("series", "p", "d", "q", R("aic", 2).alias("aic"), F.size("forecast").alias("steps"))


def _walk(s, d):
    w = Window.partitionBy("series").orderBy("Date")
    return _series(s, d).withColumn("pred", F.lag("value").over(w)).where("pred is not null").withColumnRenamed("value", "truth")


def _g3(s, d):
    return _rounded(S.forecast_metrics(_walk(s, d), ["series"]), "series")


METRICS = """SELECT series, sqrt(avg(pow(truth - pred, 2))) AS rmse, avg(abs(truth - pred)) AS mae, avg(abs(truth - pred) / (abs(truth) + 1e-8)) * 100 AS mape, avg(CASE WHEN dt IS NOT NULL THEN CASE WHEN dt = dp THEN 1.0 ELSE 0.0 END END) * 100 AS direction FROM
 (SELECT series, truth, pred, sign(truth - lag(truth) OVER w) AS dt, sign(pred - lag(pred) OVER w) AS dp FROM (SELECT series, Date, value AS truth, lag(value) OVER (PARTITION BY series ORDER BY Date) AS pred FROM named) WHERE pred IS NOT NULL WINDOW w AS (PARTITION BY series ORDER BY Date)) GROUP BY series"""


def _metrics(s, d):
    m = S.forecast_metrics(_walk(s, d), ["series"])
    return m.select("series", "rmse", F.when(F.col("series") != "EUR", F.col("mape")).alias("mape"), (F.length("series") * 10.0).alias("aic"), "direction")


def _g4(s, d):
    return _rounded(S.rank_series(_metrics(s, d)).drop("direction"), "series")


G4 = """SELECT series, round(rmse, 6) AS rmse, round(mape, 6) AS mape, aic, round(score, 6) AS score, rank() OVER (ORDER BY score) AS rank, round((aic - min(aic) OVER ()) / (max(aic) OVER () - min(aic) OVER ()) * 100, 6) AS aic_scaled,
 CASE WHEN score < 2 THEN 'Excellent' WHEN score < 5 THEN 'Good' WHEN score < 10 THEN 'Fair' ELSE 'Poor' END AS grade FROM (SELECT *, coalesce(mape, rmse * 10) AS score FROM (SELECT series, rmse, CASE WHEN series <> 'EUR' THEN mape END AS mape, length(series) * 10.0 AS aic FROM metrics))"""


def _g5(s, d):
    return _rounded(S.normalise_metrics(_metrics(s, d), ["rmse", "mape", "direction"], ["direction"]).drop("aic"), "series")


G5 = "SELECT series, round(rmse / max(rmse) OVER (), 6) AS rmse, round(mape / max(mape) OVER (), 6) AS mape, round(direction / 100, 6) AS direction FROM (SELECT series, rmse, coalesce(CASE WHEN series <> 'EUR' THEN mape END, (SELECT quantile_cont(mape, 0.5) FROM metrics WHERE series <> 'EUR')) AS mape, direction FROM metrics)"


def _log_returns(s, d):
    return V.index_series(s, d).select(F.lit("index").alias("series"), "Date", X.log_return("px", []).alias("value")).where("value is not null")


def _g6(s, d):
    asof = _log_returns(s, d).select(F.last_day("Date").alias("asof")).distinct()
    out = S.fit_hmm(S.asof_windows(_log_returns(s, d), asof))
    return out.select("series", "asof", R(F.element_at("var", 1), 4).alias("low_var"), R(F.element_at("var", 2), 4).alias("high_var"))


HMM = ([0.0, 0.0], [0.01, 0.25], [0.95, 0.9])


def _g7(s, d):
    return S.viterbi(_log_returns(s, d), *HMM)


_LOW, _HIGH = "-0.5 * (ln(2 * pi() * 0.01) + pow(r, 2) / 0.01)", "-0.5 * (ln(2 * pi() * 0.25) + pow(r, 2) / 0.25)"
LR = "SELECT Date, r, row_number() OVER (ORDER BY Date) AS n FROM (SELECT Date, ln(px / lag(px) OVER (ORDER BY Date)) AS r FROM index_series) WHERE r IS NOT NULL"
FORWARD = f"""SELECT n, Date, ln(0.5) + {_LOW} AS l0, ln(0.5) + {_HIGH} AS l1, 0 AS p0, 1 AS p1 FROM lr WHERE n = 1 UNION ALL
 SELECT x.n, x.Date, greatest(l0 + ln(0.95), l1 + ln(0.1)) + {_LOW.replace('(r,', '(x.r,')}, greatest(l1 + ln(0.9), l0 + ln(0.05)) + {_HIGH.replace('(r,', '(x.r,')}, CASE WHEN l0 + ln(0.95) >= l1 + ln(1 - 0.9) THEN 0 ELSE 1 END, CASE WHEN l1 + ln(0.9) >= l0 + ln(1 - 0.95) THEN 1 ELSE 0 END FROM forward_pass f JOIN lr x ON x.n = f.n + 1"""
BACK = """SELECT n, Date, CASE WHEN l1 > l0 THEN 1 ELSE 0 END AS state, CASE WHEN l1 > l0 THEN p1 ELSE p0 END AS prev FROM forward_pass WHERE n = (SELECT max(n) FROM forward_pass) UNION ALL
 SELECT f.n, f.Date, b.prev, CASE WHEN b.prev = 1 THEN f.p1 ELSE f.p0 END FROM back_pass b JOIN forward_pass f ON f.n = b.n - 1"""


def _pairs(s, d):
    own = V.bars(s, d).select("Company", "Date", X.pct_change("Close", ["Company"]).alias("y"))
    idx = V.index_series(s, d).select("Date", X.pct_change("px", []).alias("x"))
    return S.align_to_index(own, idx, 60)


PAIRS = "SELECT Company, Date, y, x FROM (SELECT *, row_number() OVER (PARTITION BY Company ORDER BY Date DESC) AS n FROM (SELECT Company, Date, Close / lag(Close) OVER (PARTITION BY Company ORDER BY Date) - 1 AS y FROM bars) JOIN (SELECT Date, ret AS x FROM idx) USING (Date) WHERE y IS NOT NULL AND x IS NOT NULL) WHERE n <= 60"
STEPS = "SELECT *, row_number() OVER (PARTITION BY Company ORDER BY Date) AS n, count(*) OVER (PARTITION BY Company) AS m FROM pairs"
KALMAN = """SELECT Company, 0::bigint AS n, 0.0::double AS a, 1.0::double AS b, 1.0::double AS p, 0.0::double AS c, 1.0::double AS s FROM (SELECT DISTINCT Company FROM steps) UNION ALL
 SELECT Company, n, a + (p + x * c) / v * e, b + (c + x * s) / v * e, p - (p + x * c) / v * (p + x * c), c - (p + x * c) / v * (c + x * s), s - (c + x * s) / v * (c + x * s) FROM
 (SELECT k.Company, z.n, k.a, k.b, k.p + 1e-6 AS p, k.c, k.s + 1e-4 AS s, z.x, (k.p + 1e-6) + 2 * z.x * k.c + z.x * z.x * (k.s + 1e-4) + 0.1 AS v, z.y - (k.a + k.b * z.x) AS e FROM kalman k JOIN steps z ON z.Company = k.Company AND z.n = k.n + 1)"""


def _g8(s, d):
    return _rounded(S.kalman_beta(_pairs(s, d)), "Company")


QUERIES = {
    "f1_feature_sets": (lambda s, d: V.companies(s, d).select("Symbol", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in E.feature_sets(V.companies(s, d), ["Symbol"])["tabular"])), "SELECT Symbol, coalesce(MarketCap, 0) AS MarketCap FROM companies"),
    "f2_zscore_by_date": (_f2, "SELECT Company, Date, round(greatest(-6, least(6, (Close - avg(Close) OVER w) / (coalesce(stddev_samp(Close) OVER w, 0) + 1e-8))), 6) AS z FROM bars WINDOW w AS (PARTITION BY Date)"),
    "f3_zscore_single_date": (lambda s, d: _f2(s, d, True), "SELECT Company, Date, round(greatest(-6, least(6, (Close - avg(Close) OVER w) / (coalesce(stddev_pop(Close) OVER w, 0) + 1e-8))), 6) AS z FROM bars WINDOW w AS (PARTITION BY Date)"),
    "f4_standard_scale": (_f4, "SELECT Company, Date, round((m1 - a) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 4) AS z FROM scores CROSS JOIN (SELECT avg(m1) AS a, stddev_pop(m1) AS sd FROM scores WHERE Date < DATE '1998-01-01')"),
    "f5_walk_forward_folds": (lambda s, d: E.walk_forward_folds(V.scores(s, d), 5).select("fold", "side", "Company", "Date"), "SELECT fold, side, Company, Date FROM sides WHERE fold IN (SELECT fold FROM good)"),
    "f6_temporal_split": (lambda s, d: E.temporal_split(V.bars(s, d).select("Company", "Date"), 0.8), "SELECT Company, Date, CASE WHEN Date <= (SELECT min(Date) FROM (SELECT Date, sum(count(*)) OVER (ORDER BY Date) / sum(count(*)) OVER () AS u FROM bars GROUP BY Date) WHERE u >= 0.8) THEN 'train' ELSE 'test' END AS side FROM bars"),
    "f7_time_series_grid": (_f7, None),
    "f8_one_hot": (_f8, "SELECT Symbol, repeat('0', (n - 1)::int) || '1' || repeat('0', (k - n)::int) AS code FROM companies JOIN (SELECT Sector, row_number() OVER (ORDER BY count(*) DESC, Sector) AS n, count(*) OVER () AS k FROM (SELECT coalesce(Sector, 'none') AS Sector FROM companies) GROUP BY Sector) c ON c.Sector = coalesce(companies.Sector, 'none')"),
    "f9_oversample_minority": (_f9, "SELECT label, max(c) OVER () AS n FROM (SELECT CASE WHEN truth > 0.9 THEN 1 ELSE 0 END AS label, count(*) AS c FROM scores GROUP BY 1)"),
    "f10_random_forest_classifier": (_forest(12, 3, "up", classify=True), None),
    "f11_mlp_classifier": (_f11, None),
    "f12_ridge_grid": (_f12, "SELECT fold, feature_set, penalty, round(error, 9) AS error FROM rr_best"),
    "f13_random_forest_regressor": (_forest(14, 2), None),
    "f14_boosted_trees": (_scored("GradientBoosting"), None),
    "f15_relevance_grade": (lambda s, d: V.scores(s, d).select("Company", "Date", E.relevance_grade("truth").alias("grade")).join(E.groups_by_date(V.scores(s, d)), "Date"), "SELECT Company, s.Date, greatest(0, least(30, floor(truth * 30)))::int AS grade, group_size, group_id FROM scores s JOIN (SELECT Date, count(*) AS group_size, row_number() OVER (ORDER BY Date) - 1 AS group_id FROM scores GROUP BY Date) g ON g.Date = s.Date"),
    "f16_stack": (_f16, None),
    "f17_soft_vote": (lambda s, d: E.soft_vote(_oof(s, d), ["fold", "Company", "Date"], ["fold"]).select("fold", "Company", "Date", R("pred").alias("pred")), VOTE),
    "f18_diverse_select": (_f18, VOTE.replace("FROM oof)", "FROM oof WHERE model IN (SELECT model FROM picked))")),
    "f19_oof_table": (lambda s, d: _rounded(_oof(s, d), "fold", "Company", "Date"), "SELECT fold, Company, Date, round(ret, 6) AS ret, round(truth, 6) AS truth, model, round(pred, 6) AS pred FROM oof"),
    "f20_oof_correlation": (lambda s, d: _rounded(E.correlations(_wide(s, d), MODELS), "a", "b"), "SELECT x.model AS a, y.model AS b, round(corr(x.pred, y.pred), 6) AS corr FROM oof x JOIN oof y USING (fold, Company, Date) WHERE x.model < y.model GROUP BY ALL"),
    "f21_rank_ic": (lambda s, d: _rounded(_ic(s, d), "model", "fold"), "SELECT model, fold, round(ic, 6) AS ic FROM ic"),
    "f22_hit_rate": (lambda s, d: _oof(s, d).groupBy("model", "fold").agg(R(E.hit_rate()).alias("hit_rate")), "SELECT model, fold, round(avg(CASE WHEN (pred - 0.5) * (truth - 0.5) > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM oof GROUP BY model, fold"),
    "f23_rmse": (lambda s, d: _oof(s, d).groupBy("model", "fold").agg(R(E.rmse()).alias("rmse")), "SELECT model, fold, round(sqrt(avg(pow(pred - truth, 2))), 6) AS rmse FROM oof GROUP BY model, fold"),
    "f24_decile_spread": (_f24, F24),
    "f25_pooled_spread": (lambda s, d: _rounded(E.pooled_spread(_oof(s, d), ["model", "fold"], ["Date", "Company"]), "model", "fold"), F25),
    "f26_summarise_folds": (lambda s, d: _rounded(E.summarise_folds(_ic(s, d), ["model"], "ic"), "model"), "SELECT model, count(ic) AS k, round(avg(ic), 6) AS mean, round(stddev_samp(ic), 6) AS sd, round(stddev_samp(ic) / sqrt(count(ic)), 6) AS se FROM ic GROUP BY model"),
    "f27_sign_test": (_f27, SIGN),
    "f28_paired_comparison": (_f28, F28),
    "f29_bootstrap_ci": (_f29, "SELECT model, round(low, 6) AS low, round(high, 6) AS high FROM boot"),
    "f30_flag_significant": (_f30, f"SELECT model, (low > 0 OR high < 0) AND p < 0.2 AS significant FROM boot JOIN ({SIGN}) USING (model)"),
    "f30_best_per_group": (_f30b, "SELECT fold, max_by(model, ic) AS model, round(max(ic), 6) AS ic FROM ic GROUP BY fold"),
    "f31_pick_ensemble": (lambda s, d: _rounded(E.pick_ensemble(_ic(s, d), MODELS[:2])), "SELECT max_by(model, ic) AS model, round(max(ic), 6) AS ic FROM (SELECT model, max_by(ic, fold) AS ic FROM ic WHERE model IN ('Ridge/embedding', 'Ridge/tabular') GROUP BY model)"),
    "f32_classification_report": (_f32, F32),
    "f33_direction_check": (lambda s, d: _rounded(E.direction_check(_oof(s, d), "pred", "ret", ["model"]), "model"), "SELECT model, round(avg(CASE WHEN (pred >= 0.5) = (ret > 0) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM oof GROUP BY model"),
    "g1_series_set": (lambda s, d: _rounded(_series(s, d), "series", "Date"), "SELECT series, Date, round(value, 6) AS value FROM named"),
    "g2_arima_grid": (_g2, None),
    "g3_forecast_metrics": (_g3, "SELECT series, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(mape, 6) AS mape, round(direction, 6) AS direction FROM metrics"),
    "g4_rank_series": (_g4, G4),
    "g5_normalise_metrics": (_g5, G5),
    "g6_fit_hmm": (_g6, None),
    "g7_viterbi": (_g7, "SELECT 'index' AS series, Date, state FROM back_pass"),
    "g8_kalman_beta": (_g8, "SELECT Company, round(CASE WHEN m < 5 THEN 0.0 ELSE a END, 6) AS alpha, round(CASE WHEN m < 5 THEN 1.0 ELSE b END, 6) AS beta FROM kalman JOIN (SELECT Company, max(n) AS n, max(m) AS m FROM steps GROUP BY Company) USING (Company, n)"),
    "g9_align_to_index": (lambda s, d: _rounded(_pairs(s, d), "Company", "Date"), "SELECT Company, Date, round(y, 6) AS y, round(x, 6) AS x FROM pairs"),
    "g10_trend_regime": (lambda s, d: S.trend_regime(V.index_series(s, d)).select("Date", R("px").alias("px"), R("sma").alias("sma"), "bull"), "SELECT Date, round(px, 6) AS px, round(sma, 6) AS sma, px > sma AS bull FROM (SELECT Date, px, CASE WHEN count(px) OVER f >= 50 THEN avg(px) OVER f END AS sma FROM index_series WINDOW f AS (ORDER BY Date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))"),
    "g10_regime_counts": (lambda s, d: S.regime_counts(S.trend_regime(V.index_series(s, d))), "SELECT count(*) FILTER (px > sma) AS bull, count(*) FILTER (NOT px > sma) AS bear FROM (SELECT px, CASE WHEN count(px) OVER f >= 50 THEN avg(px) OVER f END AS sma FROM index_series WINDOW f AS (ORDER BY Date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))"),
}
MORE = {"boot": BOOT, "filled": FILLED, "days": DAYS, "cuts": CUTS, "sides": SIDES, "good": GOOD, "tests": TEST, **RIDGE, **PICKED, "ic": IC, "idx": IDX, "named": SERIES, "metrics": METRICS, "lr": LR, "forward_pass": FORWARD, "back_pass": BACK, "pairs": PAIRS, "steps": STEPS, "kalman": KALMAN}
ORACLES = {k: oracle(sql, **MORE) for k, (_, sql) in QUERIES.items() if sql}
