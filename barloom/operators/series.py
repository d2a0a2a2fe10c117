"""Time series, many at once: forecasting grids, regimes, and betas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import features as X
from barloom.functions.scan import Recurrence, along, max_plus


def series_set(index: DataFrame, rates: DataFrame, first: DataFrame) -> DataFrame:
    """(series, Date, value): the index level, its return and 20-row volatility in %, the rates, and the first company's close."""
    moved = index.withColumn("ret", X.pct_change("px", []))
    moved = moved.withColumn("volatility", X.full_window(F.stddev_samp, "ret", 20, []))
    long = moved.select("Date", F.col("px").alias("level"), (F.col("ret") * 100).alias("return_pct"), (F.col("volatility") * 100).alias("volatility_pct")).unpivot(["Date"], ["level", "return_pct", "volatility_pct"], "series", "value")
    rate = rates.select("Date", "EUR", "JPY").unpivot(["Date"], ["EUR", "JPY"], "series", "value")
    close = first.select("Date", F.lit("first_close").alias("series"), F.col("Close").alias("value"))
    return long.unionByName(rate).unionByName(close).where("value is not null").select("series", "Date", "value")


def _css(y: np.ndarray, p: int, d: int, q: int) -> tuple[np.ndarray, float]:
    """(coefficients, AIC) of an ARMA(p, q) with constant on the d-th difference, by conditional least squares in two passes."""
    z = np.diff(y, d) if d else y
    n, k = len(z), max(p, q)
    if n - k <= p + q + 2:
        return np.zeros(p + q + 1), float("inf")
    rows = lambda e, lags: [e[k - i : n - i] for i in range(1, lags + 1)]
    ones = np.ones(n - k)
    long = min(max(2 * k, 5), n // 3) if q else 0
    e = np.zeros(n)
    if q:
        a = np.column_stack([np.ones(n - long), *[z[long - i : n - i] for i in range(1, long + 1)]])
        e[long:] = z[long:] - a @ np.linalg.lstsq(a, z[long:], rcond=None)[0]
    design = np.column_stack([ones, *rows(z, p), *rows(e, q)])
    beta = np.linalg.lstsq(design, z[k:], rcond=None)[0]
    rss = float(((z[k:] - design @ beta) ** 2).sum())
    return beta, (n - k) * float(np.log(max(rss / (n - k), 1e-12))) + 2 * (p + q + 2)


def _forecast(y: np.ndarray, order: tuple[int, int, int], beta: np.ndarray, steps: int) -> np.ndarray:
    p, d, q = order
    z = np.diff(y, d) if d else y.copy()
    k, e = max(p, q), np.zeros(len(z) + steps)
    z = np.concatenate([z, np.zeros(steps)])
    for t in range(k, len(z)):
        fit = beta[0] + sum(beta[i] * z[t - i] for i in range(1, p + 1)) + sum(beta[p + i] * e[t - i] for i in range(1, q + 1))
        if t < len(z) - steps:
            e[t] = z[t] - fit
        else:
            z[t] = fit
    out = z[-steps:]
    for i in range(d, 0, -1):
        out = np.diff(y, i - 1)[-1] + np.cumsum(out)
    return out


def arima_grid(series: DataFrame, max_p: int = 3, max_d: int = 2, max_q: int = 3, least: int = 50, train: float = 0.8) -> DataFrame:
    """(series, p, d, q, aic, forecast): every order of every series is fitted by itself, one task row for each.

    Orders that the data cannot carry have no aic. forecast covers the rows after the training share.
    """
    spark = series.sparkSession
    orders = spark.createDataFrame([(p, d, q) for p in range(max_p + 1) for d in range(max_d + 1) for q in range(max_q + 1)], "p int, d int, q int")
    whole = series.groupBy("series").agg(F.transform(F.array_sort(F.collect_list(F.struct("Date", "value"))), lambda x: x["value"]).alias("y")).where(F.size("y") >= least)
    cells = whole.join(F.broadcast(orders)).repartition("series", "p", "d", "q")  # a fixed number of orders

    def fit(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                y = np.asarray(r.y, float)
                cut = int(len(y) * train)
                beta, aic = _css(y[:cut], r.p, r.d, r.q)
                ahead = _forecast(y[:cut], (r.p, r.d, r.q), beta, len(y) - cut) if np.isfinite(aic) else []
                out.append((r.series, r.p, r.d, r.q, aic if np.isfinite(aic) else None, [float(x) for x in ahead]))
            yield pd.DataFrame(out, columns=["series", "p", "d", "q", "aic", "forecast"])

    return cells.mapInPandas(fit, "series string, p int, d int, q int, aic double, forecast array<double>")


def best_order(grid: DataFrame) -> DataFrame:
    return grid.where("aic is not null").groupBy("series").agg(F.min_by(F.struct("p", "d", "q", "aic", "forecast"), F.struct("aic", "p", "d", "q")).alias("b")).select("series", "b.*")


def forecast_metrics(df: DataFrame, by: list[str], truth: str = "truth", pred: str = "pred", order: str = "Date") -> DataFrame:
    """(by, rmse, mae, mape, direction): mape guards by 1e-8, direction compares the signs of first differences, both in %."""
    w = Window.partitionBy(*by).orderBy(order)
    diff = lambda c: F.signum(F.col(c) - F.lag(c).over(w))
    rows = df.withColumn("_same", F.when(diff(truth).isNotNull(), (diff(truth) == diff(pred)).cast("double")))
    err = F.col(truth) - F.col(pred)
    return rows.groupBy(*by).agg(F.sqrt(F.avg(err**2)).alias("rmse"), F.avg(F.abs(err)).alias("mae"), (F.avg(F.abs(err) / (F.abs(truth) + 1e-8)) * 100).alias("mape"), (F.avg("_same") * 100).alias("direction"))


def rank_series(df: DataFrame) -> DataFrame:
    """(series, rmse, mape, aic) with score (mape, else rmse x 10), rank, aic_scaled 0 to 100, and class."""
    everything = Window.partitionBy()  # one row a series
    scored = df.withColumn("score", F.coalesce("mape", F.col("rmse") * 10))
    low, high = F.min("aic").over(everything), F.max("aic").over(everything)
    scaled = F.when(high == low, 0.0).otherwise((F.col("aic") - low) / (high - low) * 100)
    grade = F.when(F.col("score") < 2, "Excellent").when(F.col("score") < 5, "Good").when(F.col("score") < 10, "Fair").otherwise("Poor")
    return scored.withColumns({"rank": F.rank().over(Window.orderBy("score")), "aic_scaled": scaled, "grade": grade})


def normalise_metrics(df: DataFrame, columns: list[str], percent: list[str]) -> DataFrame:
    """Gaps filled by the median, then divided by the largest; percent columns by 100."""
    w = Window.partitionBy()  # one row a series
    filled = df.withColumns({c: F.coalesce(F.col(c), F.percentile(c, 0.5).over(w)) for c in columns})
    return filled.withColumns({c: F.col(c) / 100 if c in percent else F.col(c) / F.nullif(F.max(c).over(w), F.lit(0.0)) for c in columns})


def asof_windows(series: DataFrame, asof: DataFrame, rows: int = 250) -> DataFrame:
    """(series, asof, values): the last `rows` values at or before each as-of date.

    Rows are numbered along their series, an as-of date takes the number of the row before it, and the windows are an
    equal join on blocks of `rows` numbers: two blocks for each as-of date, not all rows before it.
    """
    w = Window.partitionBy("series").orderBy("Date")
    numbered = series.withColumn("_n", F.row_number().over(w))
    marks = numbered.select("series", "Date", "_n").unionByName(series.select("series").distinct().join(F.broadcast(asof)).select("series", F.col("asof").alias("Date"), F.lit(None).cast("int").alias("_n")))  # calendar dates
    upto = Window.partitionBy("series").orderBy("Date", F.col("_n").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    ends = marks.withColumn("_end", F.max("_n").over(upto)).where("_n is null and _end is not null").select("series", F.col("Date").alias("asof"), "_end").distinct()
    block = lambda c: F.floor(F.col(c) / rows)
    wanted = ends.withColumn("_b", F.explode(F.array(block("_end"), block("_end") - 1)))
    joined = numbered.withColumn("_b", block("_n")).join(wanted, ["series", "_b"]).where((F.col("_n") <= F.col("_end")) & (F.col("_n") > F.col("_end") - rows))
    return joined.groupBy("series", "asof").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "value"))), lambda x: x["value"]).alias("values"))


#: What a window of fewer than LEAST values gets, and the start of the fit.
LEAST, DEFAULT_VAR, DEFAULT_STAY, START_STAY, CALM_PERCENTILE = 10, (1e-4, 4e-4), (0.9, 0.9), (0.95, 0.90), 70


def baum_welch(x: np.ndarray, rounds: int = 100, tol: float = 1e-4) -> dict:
    """Two Gaussian states, ordered by variance; missing values are left out.

    At the start the calm state has the values whose distance from the median is at most its CALM_PERCENTILE, and the
    other state has the rest.
    """
    x = x[~np.isnan(x)]
    if len(x) < LEAST:
        return {"mean": [0.0, 0.0], "var": list(DEFAULT_VAR), "stay": list(DEFAULT_STAY), "last": [0.5, 0.5], "loglik": 0.0}
    off = np.abs(x - np.median(x))
    calm = off <= np.percentile(off, CALM_PERCENTILE)
    groups = [x[calm], x[~calm]] if not calm.all() else [x, x]
    mean, var = np.array([g.mean() for g in groups]), np.array([groups[0].var(), groups[1].var() * (4.0 if calm.all() else 1.0)])
    o = np.argsort(var, kind="stable")
    mean, var = mean[o], np.maximum(var[o], 1e-8)
    trans = np.array([[START_STAY[0], 1 - START_STAY[0]], [1 - START_STAY[1], START_STAY[1]]])
    start, before = np.array([0.5, 0.5]), -np.inf
    for _ in range(rounds):
        logb = -0.5 * (np.log(2 * np.pi * var) + (x[:, None] - mean) ** 2 / var)
        top = logb.max(axis=1)
        b = np.exp(logb - top[:, None])
        alpha, scale = np.zeros_like(b), np.zeros(len(x))
        for t in range(len(x)):
            a = (start if t == 0 else alpha[t - 1] @ trans) * b[t]
            scale[t] = a.sum() + 1e-300
            alpha[t] = a / scale[t]
        beta = np.ones_like(b)
        for t in range(len(x) - 2, -1, -1):
            beta[t] = trans @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
        gamma = alpha * beta
        gamma /= gamma.sum(axis=1, keepdims=True)
        loglik = float((np.log(scale) + top).sum())
        if abs(loglik - before) < tol:
            break
        before = loglik
        xi = (alpha[:-1, :, None] * trans * (b[1:] * beta[1:] / scale[1:, None])[:, None, :]).sum(axis=0)
        trans, start = xi / (xi.sum(axis=1, keepdims=True) + 1e-300), gamma[0]
        weight = gamma.sum(axis=0) + 1e-300
        mean = (gamma * x[:, None]).sum(axis=0) / weight
        var = np.maximum((gamma * (x[:, None] - mean) ** 2).sum(axis=0) / weight, 1e-8)
    o = np.argsort(var, kind="stable")
    return {"mean": mean[o].tolist(), "var": var[o].tolist(), "stay": [float(trans[i, i]) for i in o], "last": gamma[-1][o].tolist(), "loglik": loglik}


def fit_hmm(windows: DataFrame) -> DataFrame:
    """(series, asof, mean, var, stay, last, loglik) of each window of values; windows are of bounded length."""
    schema = "series string, asof date, mean array<double>, var array<double>, stay array<double>, last array<double>, loglik double"

    def fit(batches):
        for b in batches:
            yield pd.DataFrame([{"series": r.series, "asof": r.asof} | baum_welch(np.asarray(r.values, float)) for r in b.itertuples(index=False)], columns=["series", "asof", "mean", "var", "stay", "last", "loglik"])

    return windows.repartition("series", "asof").mapInPandas(fit, schema)


def viterbi(series: DataFrame, mean: list[float], var: list[float], stay: list[float]) -> DataFrame:
    """(series, Date, state): the likeliest path of two states with given parameters.

    A missing value speaks for neither state. The scores of the best paths are a recurrence in the max-plus algebra; which
    state each came from is one backwards, from the better state of the last date. So a series of any length is many tasks.
    """
    mu, v = np.array(mean), np.array(var)
    with np.errstate(divide="ignore"):
        moves = np.log(np.array([[stay[0], 1 - stay[1]], [1 - stay[0], stay[1]]]))  # to, from
    apart = np.where(np.eye(2) > 0, 0.0, -np.inf)

    def forward(x: np.ndarray, before: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        emit = np.nan_to_num(-0.5 * (np.log(2 * np.pi * v) + (x[:, None] - mu) ** 2 / v), nan=0.0)
        return np.where(fresh[:, None, None], apart, moves) + emit[:, :, None]

    def came(s: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        """Into a number: where the next row's states come from (1 and 2: state 0 or 1 comes from state 1), and the better one here."""
        kept0, moved0, kept1, moved1 = s[:, 0] + moves[0, 0], s[:, 1] + moves[0, 1], s[:, 1] + moves[1, 1], s[:, 0] + moves[1, 0]
        return {"came": (kept0 < moved0) * 1.0 + (kept1 >= moved1) * 2.0 + (s[:, 1] > s[:, 0]) * 4.0}

    def back(x: np.ndarray, before: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        code = x.astype(int)
        from0, from1 = np.where(fresh, code // 4, code % 2), np.where(fresh, code // 4, code // 2 % 2)
        return np.stack([np.stack([1.0 - from0, 1.0 - from1], 1), np.stack([from0, from1], 1).astype(float)], 1)

    there = Recurrence(forward, np.log([0.5, 0.5]), came, {"came": "double"}, max_plus)
    home = Recurrence(back, np.array([1.0, 0.0]), lambda s, x: {"state": s[:, 1].round().astype(np.int32)}, {"state": "int"})
    scored = along(series.select("series", "Date", F.col("value").cast("double").alias("value")), "value", there, "series", "Date").drop("value")
    return along(scored, "came", home, "series", "Date", descending=True).drop("came")


def kalman_beta(pairs: DataFrame, q: tuple[float, float] = (1e-6, 1e-4), r: float = 0.1, least: int = 5, key: str = "Company", date: str = "Date", y: str = "y", x: str = "x") -> DataFrame:
    """(key, alpha, beta): intercept and slope of y on x after a two-state filter that starts at (0, 1); slope 1 below `least` rows."""
    rows = pairs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(date, y, x))).alias("_z"))
    start = F.struct(*(F.lit(v).alias(n) for n, v in (("a", 0.0), ("b", 1.0), ("p", 1.0), ("c", 0.0), ("s", 1.0))))

    def step(k, z):
        p, s, c, u = k["p"] + q[0], k["s"] + q[1], k["c"], z[x]
        v = p + 2 * u * c + u * u * s + r
        ga, gb = (p + u * c) / v, (c + u * s) / v
        e = z[y] - (k["a"] + k["b"] * u)
        return F.struct((k["a"] + ga * e).alias("a"), (k["b"] + gb * e).alias("b"), (p - ga * (p + u * c)).alias("p"), (c - ga * (c + u * s)).alias("c"), (s - gb * (c + u * s)).alias("s"))

    out = rows.withColumn("_k", F.aggregate("_z", start, step))
    enough = F.size("_z") >= least
    return out.select(key, F.when(enough, F.col("_k.a")).otherwise(0.0).alias("alpha"), F.when(enough, F.col("_k.b")).otherwise(1.0).alias("beta"))


def align_to_index(returns: DataFrame, index: DataFrame, rows: int = 60, key: str = "Company", date: str = "Date") -> DataFrame:
    """(key, date, y, x) of the last rows that both have."""
    joined = returns.join(index, date).where("y is not null and x is not null")
    return joined.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(date)))).where(F.col("_n") <= rows).drop("_n")


def trend_regime(index: DataFrame, n: int = 50, date: str = "Date") -> DataFrame:
    """(date, px, sma, bull): bull where the level is above its mean over n rows; null before there are n."""
    return index.withColumn("sma", X.full_window(F.avg, "px", n, [], date)).withColumn("bull", F.col("px") > F.col("sma"))


def regime_counts(regimes: DataFrame) -> DataFrame:
    return regimes.agg(F.count_if(F.col("bull")).alias("bull"), F.count_if(~F.col("bull")).alias("bear"))


