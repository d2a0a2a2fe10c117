"""Feature columns over ordered series and over cross-sections, as window expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scan import Recurrence, along


def by_key(key: str = "Company", date: str = "Date"):
    return Window.partitionBy(key).orderBy(date)


def _frame(n: int, key: str, date: str):
    """The row and the n before it."""
    return by_key(key, date).rowsBetween(-n, 0)


def lag_return(c: str, n: int, key: str = "Company", date: str = "Date") -> Column:
    before = F.lag(c, n).over(by_key(key, date))
    return (F.col(c) - before) / F.nullif(before, F.lit(0.0))


def price_vs_ma(c: str, n: int, key: str = "Company", date: str = "Date") -> Column:
    mean = F.avg(c).over(_frame(n, key, date))
    return (F.col(c) - mean) / F.nullif(mean, F.lit(0.0))


def stochastic(c: str, n: int = 20, key: str = "Company", date: str = "Date") -> Column:
    low, high = F.min(c).over(_frame(n, key, date)), F.max(c).over(_frame(n, key, date))
    return (F.col(c) - low) / F.nullif(high - low, F.lit(0.0))


def volume_ratio(c: str, n: int = 5, key: str = "Company", date: str = "Date") -> Column:
    return F.col(c) / F.nullif(F.avg(c).over(_frame(n, key, date)), F.lit(0.0))


def rolling_volatility(c: str, n: int, key: str = "Company", date: str = "Date") -> Column:
    return F.stddev_samp(c).over(_frame(n, key, date))


def day_of_week(date: str) -> Column:
    return F.dayofweek(date) - 1


def vol_adjusted_return(ret: str, vol: str) -> Column:
    return F.col(ret) / F.nullif(F.col(vol), F.lit(0.0))


def rolling_zscore(c: str, n: int = 20, key: str = "Company", date: str = "Date") -> Column:
    w = _frame(n, key, date)
    return (F.col(c) - F.avg(c).over(w)) / F.nullif(F.stddev_samp(c).over(w), F.lit(0.0))


def group_mean_by_date(c: str, group: str, date: str = "Date") -> Column:
    return F.avg(c).over(Window.partitionBy(group, date))


def cross_section_rank(c: str, date: str = "Date") -> Column:
    return F.percent_rank().over(Window.partitionBy(date).orderBy(F.col(c).asc_nulls_last()))


def log_size(cap: str) -> Column:
    return F.log10(F.when(F.col(cap) > 0, F.col(cap)))


def rsi(df: DataFrame, price: str, n: int = 14, key: str = "Company", date: str = "Date") -> DataFrame:
    """df's series with rsi: weighted means of gains and losses (weights (1 - 1/n) to the age), 50 before n changes, and a zero loss is 1e-9.

    A row without price, and the row after it, has no change and keeps the means of the row before. The sums of gains,
    losses and weights are a recurrence, so a series of any length is many tasks.
    """
    q = 1 - 1 / n

    def steps(x: np.ndarray, before: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        move = x - before
        known = ~np.isnan(move)
        m = np.tile(np.eye(5), (len(x), 1, 1))  # gains, losses, weights, changes, 1
        m[known, :3, :3] *= q
        m[known, 0, 4], m[known, 1, 4] = np.maximum(move[known], 0), np.maximum(-move[known], 0)
        m[known, 2, 4] = m[known, 3, 4] = 1
        return m

    def outputs(s: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        gain, loss = (s[:, i] / np.where(s[:, 2] > 0, s[:, 2], 1) for i in (0, 1))
        return {"rsi": np.where(s[:, 3] >= n, 100 - 100 / (1 + gain / np.where(loss != 0, loss, 1e-9)), 50.0)}

    rule = Recurrence(steps, np.array([0.0, 0, 0, 0, 1]), outputs, {"rsi": "double"})
    return along(df.select(key, date, F.col(price).cast("double").alias(price)), price, rule, key, date)


def macd(df: DataFrame, price: str, fast: int = 12, slow: int = 26, signal: int = 9, key: str = "Company", date: str = "Date") -> DataFrame:
    """df's series with macd and macd_signal: recursive exponential means that start at the first value; 0 before it.

    A row without price keeps the means of the row before. The means are a recurrence, so a series of any length is many
    tasks.
    """
    a, b, c = (2 / (span + 1) for span in (fast, slow, signal))

    def steps(x: np.ndarray, before: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        known = ~np.isnan(x)
        m = np.tile(np.eye(5), (len(x), 1, 1))  # the fast and the slow mean, the signal, whether there was a price, 1
        for i, share in ((0, a), (1, b)):  # the first price is the mean itself
            m[known, i, i], m[known, i, 3], m[known, i, 4] = 1 - share, -(1 - share) * x[known], x[known]
        m[known, 3, 3], m[known, 3, 4] = 0, 1
        m[:, 2] = c * (m[:, 0] - m[:, 1])
        m[:, 2, 2] = 1 - c
        return m

    def outputs(s: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        return {"macd": s[:, 0] - s[:, 1], "macd_signal": s[:, 2]}

    rule = Recurrence(steps, np.array([0.0, 0, 0, 0, 1]), outputs, {"macd": "double", "macd_signal": "double"})
    return along(df.select(key, date, F.col(price).cast("double").alias(price)), price, rule, key, date)


def bollinger_width(c: str, n: int = 20, key: str = "Company", date: str = "Date") -> Column:
    w = _frame(n - 1, key, date)
    mean = F.avg(c).over(w)
    full = F.count(c).over(w) >= n
    return F.when(full, F.coalesce(4 * F.stddev_samp(c).over(w) / F.when(mean == 0, 1e-9).otherwise(mean), F.lit(0.0))).otherwise(0.0)


def lag_feature(c: str, k: int, default: float, key: str = "Company", date: str = "Date") -> Column:
    return F.coalesce(F.lag(c, k).over(by_key(key, date)), F.lit(default))


#: What a missing feature is when serving.
FILLS = {"return": 0.0, "ratio": 1.0, "volatility": 0.0, "rank": 0.5, "rsi": 50.0}


def live_features(df: DataFrame, price: str = "px", volume: str = "vol", key: str = "Company", date: str = "Date", fill: dict[str, float] | None = None) -> DataFrame:
    """The feature columns with a fill policy; an empty policy keeps nulls."""
    fill = FILLS if fill is None else fill
    some = lambda c, kind: F.coalesce(c, F.lit(fill[kind])) if kind in fill else c
    out = df.select(
        key, date, price, volume,
        *(some(lag_return(price, n, key, date), "return").alias(f"return_{n}d") for n in (1, 5, 10)),
        *(some(price_vs_ma(price, n, key, date), "return").alias(f"vs_ma_{n}") for n in (5, 20)),
        some(volume_ratio(volume, 5, key, date), "ratio").alias("volume_ratio"),
        *(some(rolling_volatility(price, n, key, date), "volatility").alias(f"volatility_{n}d") for n in (5, 10)),
    )
    return out.withColumns({f"rank_{c}": some(cross_section_rank(c, date), "rank") for c in ("return_5d", "volatility_10d")})


def adv_usd(price: str, volume: str, n: int = 20, key: str = "Company", date: str = "Date") -> Column:
    return F.coalesce(F.avg(F.col(price) * F.col(volume)).over(_frame(n, key, date)), F.lit(1e6))


def return_volatility(ret: str, n: int = 20, default: float = 0.01, key: str = "Company", date: str = "Date") -> Column:
    return F.coalesce(F.stddev_samp(ret).over(_frame(n, key, date)), F.lit(default))


def full_window(agg, c: str, n: int, key: list[str], date: str = "Date") -> Column:
    """agg over n rows, null before there are n."""
    w = Window.partitionBy(*key).orderBy(date).rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(w) >= n, agg(c).over(w))


def log_return(c: str, key: list[str], date: str = "Date") -> Column:
    return F.log(F.col(c) / F.lag(c).over(Window.partitionBy(*key).orderBy(date)))


def pct_change(c: str, key: list[str], date: str = "Date") -> Column:
    return F.col(c) / F.lag(c).over(Window.partitionBy(*key).orderBy(date)) - 1


def volume_pressure(volume: str, key: str = "Company") -> Column:
    return F.col(volume) / F.nullif(F.avg(volume).over(Window.partitionBy(key)), F.lit(0.0))


def rank_pct(c: str, *by: str) -> Column:
    """Rank with ties averaged, as a share of the group."""
    tied = F.count("*").over(Window.partitionBy(*by, c))
    return (F.rank().over(Window.partitionBy(*by).orderBy(c)) + (tied - 1) / 2) / F.count(c).over(Window.partitionBy(*by))


def latest_row_per_key(df: DataFrame, key: str = "Company", date: str = "Date") -> DataFrame:
    """The last row of each key: a map-side combined maximum, no sort."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), date).alias("_r")).select(key, *(f"_r.{c}" for c in rest))


def first_value_per_date(df: DataFrame, value: str, key: str, date: str = "Date") -> DataFrame:
    return df.groupBy(date).agg(F.min_by(value, key).alias(value))
