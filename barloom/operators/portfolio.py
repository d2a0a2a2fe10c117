"""Scores to weights, orders, costs, equity and attribution: every table is keyed by strategy, date and ticker."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def every_nth_date(calendar: DataFrame, n: int = 5, date: str = "Date") -> DataFrame:
    """Each n-th of the distinct dates, the first included."""
    return calendar.select(date).distinct().withColumn("_n", F.row_number().over(Window.orderBy(date))).where((F.col("_n") - 1) % n == 0).select(date)


def fridays(calendar: DataFrame, date: str = "Date") -> DataFrame:
    """All Fridays between the first and the last date."""
    ends = calendar.agg(F.min(date).alias("a"), F.max(date).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b")).alias(date)).where(F.dayofweek(date) == 6)


def first_fridays(calendar: DataFrame, date: str = "Date") -> DataFrame:
    return fridays(calendar, date).groupBy(F.date_trunc("month", date).alias("_m")).agg(F.min(date).alias(date)).select(date)


def period_return(rebalance: DataFrame, prices: DataFrame, final: DataFrame, price: str = "Close", key: str = "Company", date: str = "Date", by: list[str] = ()) -> DataFrame:
    """(by, key, date, next_date, ret) from one rebalance to the next, the last to the final date; names without a positive price at both ends have no row."""
    periods = rebalance.select(*by, date).distinct().join(F.broadcast(final.select(F.col(date).alias("_f"))), F.col(date) < F.col("_f"))
    periods = periods.withColumn("next_date", F.coalesce(F.lead(date).over(Window.partitionBy(*by).orderBy(date)), "_f")).drop("_f")
    now = prices.where(F.col(price) > 0).select(key, date, F.col(price).alias("_now"))
    then = prices.where(F.col(price) > 0).select(key, F.col(date).alias("next_date"), F.col(price).alias("_then"))
    return periods.join(now, date).join(then, [key, "next_date"]).select(*by, key, date, "next_date", (F.col("_then") / F.col("_now") - 1).alias("ret"))


def compare_runs(weights: DataFrame, prices: DataFrame, horizons: DataFrame, cadences: DataFrame, universes: DataFrame, cash: float = 1e5, fee: float = 0.001) -> DataFrame:
    """Performance of every run of the grid strategy x horizon x cadence x universe, all in one job.

    weights (strategy, Company, Date, weight), horizons (horizon, start), cadences (cadence, Date: the rebalance dates),
    universes (universe, Company). A run holds its universe's names at its cadence's dates from its start on, weights
    scaled to a gross sum of 1, each from one of its dates to the next.
    """
    run = ["strategy", "horizon", "cadence", "universe"]
    # horizons and cadences are a few rows and calendar dates
    held = weights.join(F.broadcast(cadences), "Date").join(universes, "Company").join(F.broadcast(horizons), F.col("Date") >= F.col("start"))
    gross = F.sum(F.abs("weight")).over(Window.partitionBy(*run, "Date"))
    held = held.withColumn("weight", F.col("weight") / F.nullif(gross, F.lit(0.0)))
    ends = period_return(cadences, prices, prices.agg(F.max("Date").alias("Date")), by=["cadence"]).select("cadence", "Company", "Date", "ret")
    joined = held.join(ends, ["cadence", "Company", "Date"], "left")
    returns = joined.groupBy(*run, "Date").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("ret"))
    return performance(equity_curve(returns, run, cash, fee), run, cash=cash)


def active_universe(prices: DataFrame) -> DataFrame:
    return prices.where((F.col("Volume") > 0) & (F.col("Close") > 0))


def universe(listing: DataFrame, n: int, per: str | None = None, tickers: list | None = None, having: DataFrame | None = None, key: str = "Symbol") -> DataFrame:
    """The n largest companies, or the n largest of each group, or given ones; of those in `having` if it is given."""
    df = listing.where(F.col(key).isin(tickers)) if tickers is not None else listing
    if having is not None:
        df = df.join(having.select(key).distinct(), key, "left_semi")
    if tickers is not None:
        return df
    w = Window.partitionBy(*([per] if per else [])).orderBy(F.col("MarketCap").desc_nulls_last(), key)
    if per is None:
        return df.orderBy(F.col("MarketCap").desc_nulls_last(), key).limit(n)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def _of(by: list[str], *order) -> Window:
    return Window.partitionBy(*by).orderBy(*order)


def top_pct_then_k(df: DataFrame, rank: str, pct: float, k: int, by: list[str], tie: str = "Company") -> DataFrame:
    """The k best of those in the top pct percent; the k best of all where none is."""
    passed = (F.col(rank) >= 1 - pct / 100).cast("int")
    some = F.max(passed).over(Window.partitionBy(*by))
    kept = df.withColumns({"_p": passed, "_s": some}).where((F.col("_p") == 1) | (F.col("_s") == 0))
    return kept.withColumn("_n", F.row_number().over(_of(by, F.desc(rank), tie))).where(F.col("_n") <= k).drop("_p", "_s", "_n")


def threshold_long(df: DataFrame, rank: str, by: list[str], least: float = 0.53, fallback: int = 2, tie: str = "Company") -> DataFrame:
    """Names of rank >= least, or the best few where none is, with weights in proportion to rank."""
    passed = F.col(rank) >= least
    some = F.max(passed.cast("int")).over(Window.partitionBy(*by))
    at = F.row_number().over(_of(by, F.desc(rank), tie))
    kept = df.withColumns({"_p": passed, "_s": some, "_n": at}).where(F.col("_p") | ((F.col("_s") == 0) & (F.col("_n") <= fallback)))
    return kept.withColumn("weight", F.col(rank) / F.sum(rank).over(Window.partitionBy(*by))).drop("_p", "_s", "_n")


def equal_weight(by: list[str]) -> Column:
    return 1.0 / F.count("*").over(Window.partitionBy(*by))


def rank_weight(rank: str, by: list[str]) -> Column:
    return F.col(rank) / F.sum(rank).over(Window.partitionBy(*by))


def threshold_returns(df: DataFrame, rank: str, ret: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.when(F.col(rank) > 0.5, F.col(ret))).alias("above_50"), F.avg(F.when(F.col(rank) > 0.53, F.col(ret))).alias("above_53"))


def inverse_vol_cap(df: DataFrame, vol: str, by: list[str], cap: float = 0.25, rounds: int = 4) -> DataFrame:
    """df with weight ~ 1 / max(vol, 0.001), no weight over cap: the excess goes to the free names, round by round; the rest is cash."""
    w = Window.partitionBy(*by)
    raw = 1 / F.greatest(F.coalesce(F.col(vol), F.lit(0.0)), F.lit(1e-3))
    df = df.withColumn("_raw", raw).withColumn("weight", F.col("_raw") / F.sum("_raw").over(w)).withColumn("_frozen", F.lit(False))
    for _ in range(rounds):
        df = df.withColumn("_frozen", F.col("_frozen") | (F.col("weight") >= cap))
        left = 1 - F.sum(F.when(F.col("_frozen"), cap).otherwise(0.0)).over(w)
        free = F.sum(F.when(F.col("_frozen"), 0.0).otherwise(F.col("_raw"))).over(w)
        df = df.withColumn("weight", F.when(F.col("_frozen"), cap).otherwise(F.greatest(left, F.lit(0.0)) * F.col("_raw") / F.when(free > 0, free).otherwise(1.0)))
    return df.withColumn("weight", F.least("weight", F.lit(cap))).drop("_raw", "_frozen")


def long_short_weights(df: DataFrame, prob: str, by: list[str], threshold: float = 0.02, bull: str | None = None) -> DataFrame:
    """Weights of prob - 0.5 beyond the threshold, divided by the sum of their sizes; where bull is true, shorts go first."""
    raw = F.col(prob) - 0.5
    kept = df.withColumn("_raw", raw).where((F.col("_raw") >= threshold) | (F.col("_raw") <= -threshold))
    if bull:
        kept = kept.where(~F.coalesce(F.col(bull), F.lit(False)) | (F.col("_raw") > 0))
    return kept.withColumn("weight", F.col("_raw") / F.sum(F.abs("_raw")).over(Window.partitionBy(*by))).drop("_raw")


def beta_scale_shorts(weight: str = "weight", beta: str = "beta") -> Column:
    return F.when(F.col(weight) < 0, F.col(weight) / F.greatest(F.abs(F.coalesce(F.col(beta), F.lit(1.0))), F.lit(0.5))).otherwise(F.col(weight))


def borrowable_filter(df: DataFrame, barred: DataFrame, key: str = "Company", weight: str = "weight") -> DataFrame:
    """df without the shorts of barred names."""
    return df.where(F.col(weight) >= 0).unionByName(df.where(F.col(weight) < 0).join(barred.select(key).distinct(), key, "left_anti").select(df.columns))


def decile_books(df: DataFrame, score: str, by: list[str], tie: str = "Company") -> DataFrame:
    """The best tenth as long and the worst as short, one name each at least."""
    n = F.count("*").over(Window.partitionBy(*by))
    k = F.greatest(F.floor(n / 10), F.lit(1))
    rows = df.withColumns({"_k": k, "_n": n, "_at": F.row_number().over(_of(by, F.desc(score), tie))})
    side = F.when(F.col("_at") <= F.col("_k"), "long").when(F.col("_at") > F.col("_n") - F.col("_k"), "short")
    return rows.withColumn("side", side).where("side is not null").drop("_k", "_n", "_at")


def _changes(old: DataFrame, new: DataFrame, keys: list[str], value: str = "weight") -> DataFrame:
    joined = old.select(*keys, F.col(value).alias("old")).join(new.select(*keys, F.col(value).alias("new")), keys, "full")
    return joined.withColumns({"old": F.coalesce("old", F.lit(0.0)), "new": F.coalesce("new", F.lit(0.0))})


def turnover(old: DataFrame, new: DataFrame, by: list[str], key: str = "Company") -> DataFrame:
    return _changes(old, new, [*by, key]).groupBy(*by).agg(F.sum(F.abs(F.col("new") - F.col("old"))).alias("turnover"))


#: Half a spread, the weight of square-root impact, and the largest cost, as shares of what is traded.
HALF_SPREAD, IMPACT, MOST = 0.0005, 0.5, 0.02


def slippage(size: Column, vol: Column, adv: Column) -> Column:
    """Cost of trading `size` dollars: half a spread and square-root impact, at most 2 percent of the size."""
    rate = F.least(F.lit(HALF_SPREAD) + IMPACT * F.coalesce(vol, F.lit(0.02)) * F.sqrt(size / F.greatest(F.coalesce(adv, F.lit(1e7)), F.lit(1.0))), F.lit(MOST))
    return size * rate


def slippage_cost(old: DataFrame, new: DataFrame, market: DataFrame, by: list[str], equity: float = 1e6, key: str = "Company") -> DataFrame:
    """(by, cost): of all moves of 1e-6 of the equity or more. market has vol and adv by key and `by`."""
    moved = _changes(old, new, [*by, key]).withColumn("_m", F.abs(F.col("new") - F.col("old"))).where("_m >= 1e-6").join(market, [*by, key], "left")
    return moved.groupBy(*by).agg(F.sum(slippage(F.col("_m") * equity, F.col("vol"), F.col("adv"))).alias("cost"))


def drift_weights(df: DataFrame, by: list[str], weight: str = "weight", ret: str = "ret") -> DataFrame:
    """Weights after a period: w (1 + r) / (1 + R)."""
    whole = F.sum(F.col(weight) * F.coalesce(F.col(ret), F.lit(0.0))).over(Window.partitionBy(*by))
    return df.withColumn("drifted", F.col(weight) * (1 + F.coalesce(F.col(ret), F.lit(0.0))) / (1 + whole))


def equity_buy_hold(prices: DataFrame, calendar: DataFrame, cash: float = 1e5, fee: float = 0.001, price: str = "Close", key: str = "Company", date: str = "Date") -> DataFrame:
    """(date, equity) of equal cash in each name at the first calendar date; missing prices stay at entry, fees at entry and exit."""
    first = calendar.agg(F.min(date).alias(date))
    last = calendar.agg(F.max(date).alias("_last"))
    entry = prices.join(F.broadcast(first), date).where(F.col(price) > 0).select(key, F.col(price).alias("_p0"))
    n = entry.agg(F.count("*").alias("_n"))
    shares = entry.join(F.broadcast(n)).withColumn("_sh", F.lit(cash * (1 - fee)) / F.col("_n") / F.col("_p0"))
    held = prices.join(shares, key).join(F.broadcast(calendar.select(date)), date)
    seen = held.groupBy(date).agg(F.sum(F.col("_sh") * F.coalesce(F.col(price), F.col("_p0"))).alias("_v"), F.sum(F.col("_sh") * F.col("_p0")).alias("_e"))
    total = shares.agg(F.sum(F.col("_sh") * F.col("_p0")).alias("_all"))
    out = calendar.select(date).join(seen, date, "left").join(F.broadcast(total)).join(F.broadcast(last))
    value = F.coalesce("_v", F.lit(0.0)) + F.col("_all") - F.coalesce("_e", F.lit(0.0))
    return out.select(date, (value * F.when(F.col(date) == F.col("_last"), 1 - fee).otherwise(1.0)).alias("equity"))


def strategy_returns(weights: DataFrame, returns: DataFrame, by: list[str], key: str = "Company", date: str = "Date") -> DataFrame:
    """(by, date, ret): weighted return of each period, names without a return count 0."""
    joined = weights.join(returns.select(key, date, "ret"), [key, date], "left")
    return joined.groupBy(*by, date).agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("ret"))


def equity_curve(periods: DataFrame, by: list[str], cash: float = 1e5, fee: float = 0.001, date: str = "Date") -> DataFrame:
    """(by, date, ret, equity): compounded period returns with a fee on both sides of each."""
    w = Window.partitionBy(*by).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    factor = F.greatest((1 - fee) * (1 + F.col("ret")) * (1 - fee), F.lit(1e-12))
    return periods.select(*by, date, "ret", (cash * F.exp(F.sum(F.log(factor)).over(w))).alias("equity"))


def equity_with_impact(positions: DataFrame, by: list[str], cash: float = 1e6, date: str = "Date", key: str = "Company") -> DataFrame:
    """(by, date, equity): cost by the equity of the moment, drifting weights, and a sale of all at the end.

    positions (by, date, key, weight, ret, vol, adv); rows of one name in a period are added up. What a name's weight
    moves by does not hang on the equity: wanted and drifted weights meet by name. Only the equity is followed period
    after period, in one group a strategy, of as many rows as it trades.
    """
    filled = positions.select(*by, date, key, "weight", F.coalesce("ret", F.lit(0.0)).alias("ret"), F.coalesce("vol", F.lit(0.02)).alias("vol"), F.coalesce("adv", F.lit(1e7)).alias("adv"))
    gains = filled.groupBy(*by, date).agg(F.sum(F.col("weight") * F.col("ret")).alias("_gain"))
    periods = gains.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(date)))
    wanted = filled.join(periods, [*by, date])
    move = lambda n, weight, is_new: wanted.select(*by, n.alias("_n"), key, weight.alias("_w"), F.struct(F.lit(is_new).alias("new"), "vol", "adv").alias("_m"))
    held = move(F.col("_n") + 1, -F.col("weight") * (1 + F.col("ret")) / (1 + F.col("_gain")), 0)
    moves = move(F.col("_n"), F.col("weight"), 1).union(held).groupBy(*by, "_n", key).agg(F.abs(F.sum("_w")).alias("_w"), F.max("_m").alias("_m"))
    trades = moves.where("_w >= 1e-6").select(*by, "_n", "_w", F.col("_m.vol").alias("_vol"), F.greatest("_m.adv", F.lit(1.0)).alias("_adv"))
    sale = periods.groupBy(*by).agg(F.lit(None).cast(positions.schema[date].dataType).alias(date), F.lit(0.0).alias("_gain"), (F.max("_n") + 1).alias("_n"))
    rows = periods.select(*by, date, "_gain", "_n").unionByName(sale).join(trades, [*by, "_n"], "left")

    def follow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_n", kind="stable")
        n = rows["_n"].to_numpy()
        starts = np.flatnonzero(np.append(True, n[1:] != n[:-1]))
        w, vol, adv, gain = (rows[c].to_numpy(float) for c in ("_w", "_vol", "_adv", "_gain"))
        equity, curve = cash, []
        for lo, hi in zip(starts, np.append(starts[1:], len(n)), strict=True):
            size = w[lo:hi] * equity
            rate = np.minimum(HALF_SPREAD + IMPACT * vol[lo:hi] * np.sqrt(size / adv[lo:hi]), MOST)
            equity = (equity - float(np.nansum(size * rate))) * (1 + gain[lo])
            curve.append(equity)
        curve[-2:] = curve[-1:]  # the sale counts for the last period
        return rows.iloc[starts[:-1]][[*by, date]].assign(equity=curve)

    schema = StructType([*(positions.schema[c] for c in [*by, date]), StructField("equity", DoubleType())])
    return rows.groupBy(*by).applyInPandas(follow, schema)


def drawdowns(curve: DataFrame, by: list[str], date: str = "Date") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return curve.withColumn("peak", F.max("equity").over(w)).withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def performance(curve: DataFrame, by: list[str], periods_a_year: float = 52.0, population: bool = False, cash: float = 1e5) -> DataFrame:
    """(by, total, sharpe, max_drawdown, win_rate, profit_factor) of a curve (date, ret, equity)."""
    sd = F.stddev_pop("ret") if population else F.stddev_samp("ret")
    lost = F.sum(F.when(F.col("ret") < 0, -F.col("ret")).otherwise(0.0))
    return drawdowns(curve, by).groupBy(*by).agg(
        (F.max_by("equity", "Date") / cash - 1).alias("total"), F.when(sd > 0, F.avg("ret") / sd * F.sqrt(F.lit(periods_a_year))).otherwise(0.0).alias("sharpe"), F.min("drawdown").alias("max_drawdown"),
        F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.when(lost > 0, F.sum(F.when(F.col("ret") > 0, F.col("ret")).otherwise(0.0)) / lost).alias("profit_factor"),
    )


def annualise(total: Column, years: Column) -> Column:
    return F.pow(1 + total, 1 / years) - 1


def differential_orders(held: DataFrame, target: DataFrame, prices: DataFrame, by: list[str], least: float = 5.0, key: str = "Company") -> DataFrame:
    """Orders that turn held dollar values into target ones: delta, action, reason, whole shares, and their order (sells first)."""
    d = _changes(held, target, [*by, key], "value").withColumn("delta", F.col("new") - F.col("old")).where(F.abs("delta") >= least)
    action = F.when(F.col("delta") > 0, "buy").otherwise("sell")
    reason = F.when(F.col("old") == 0, "open").when(F.col("new") == 0, "close").when(F.col("old") * F.col("new") < 0, "flip").when(F.abs("new") > F.abs("old"), "increase").otherwise("reduce")
    priced = d.join(prices, [*by, key], "left").withColumns({"action": action, "reason": reason})
    shares = F.floor(F.abs("delta") / F.nullif(F.col("price"), F.lit(0.0)))
    at = F.row_number().over(_of(by, F.when(F.col("action") == "sell", 0).otherwise(1), key))
    return priced.select(*by, key, "old", "new", "delta", "action", "reason", shares.alias("shares"), at.alias("position"))


def traded_volume(held: DataFrame, target: DataFrame, by: list[str], least: float = 5.0, key: str = "Company") -> DataFrame:
    """(by, naive, differential, saved): selling all and buying anew, against trading the differences."""
    d = _changes(held, target, [*by, key], "value")
    delta = F.abs(F.col("new") - F.col("old"))
    out = d.groupBy(*by).agg(F.sum(F.abs("old") + F.abs("new")).alias("naive"), F.sum(F.when(delta >= least, delta).otherwise(0.0)).alias("differential"))
    return out.withColumn("saved", F.when(F.col("naive") > 0, 1 - F.col("differential") / F.col("naive")))


def weekly_ledger(held: DataFrame, curve: DataFrame, benchmark: DataFrame, regime: DataFrame, by: list[str], date: str = "Date", key: str = "Company") -> DataFrame:
    """One row a period: regime, picks as text, value, return and the benchmark's."""
    picks = held.groupBy(*by, date).agg(F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), ",").alias("picks"))
    return picks.join(curve, [*by, date]).join(benchmark, date, "left").join(regime, date, "left").select(*by, date, "bull", "picks", "equity", "ret", "benchmark")


def attribution(weights: DataFrame, returns: DataFrame, betas: DataFrame, market: DataFrame, by: list[str], key: str = "Company") -> DataFrame:
    """(by, realised, regime, selection, beta, residual): net exposure times the market; weights times demeaned returns; beta beyond the net exposure; the rest."""
    j = weights.join(returns, [*by, key], "full").join(betas, key, "left").join(market, by, "left")
    j = j.withColumns({"weight": F.coalesce("weight", F.lit(0.0)), "ret": F.coalesce("ret", F.lit(0.0)), "beta": F.coalesce("beta", F.lit(1.0)), "market": F.coalesce("market", F.lit(0.0))})
    j = j.withColumn("_mean", F.avg("ret").over(Window.partitionBy(*by)))
    w = F.col("weight")
    out = j.groupBy(*by).agg(F.sum(w * F.col("ret")).alias("realised"), (F.sum(w) * F.max("market")).alias("regime"), F.sum(w * (F.col("ret") - F.col("_mean"))).alias("selection"), ((F.sum(w * F.col("beta")) - F.sum(w)) * F.max("market")).alias("beta"))
    return out.withColumn("residual", F.col("realised") - F.col("regime") - F.col("selection") - F.col("beta"))


def realised_window_return(prices: DataFrame, since: str, price: str = "Close", key: str = "Company", date: str = "Date") -> DataFrame:
    out = prices.where(F.col(date) >= F.lit(since).cast("date")).groupBy(key).agg(F.min_by(price, date).alias("_a"), F.max_by(price, date).alias("_b"), F.count("*").alias("n")).where("n >= 2")
    return out.select(key, (F.col("_b") / F.col("_a") - 1).alias("ret"), "n")


def decision_id(*parts) -> Column:
    """First 16 hex digits of SHA-256 over the parts."""
    return F.substr(F.sha2(F.concat_ws("|", *parts), 256), F.lit(1), F.lit(16))


def frame_hash(df: DataFrame) -> DataFrame:
    """(n, hash): of a table's rows in any order, columns in any order: the sum of the first 60 bits of each row's MD5.

    A row's text is its values by column name, each as a string, null as \\N.
    """
    row = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in sorted(df.columns)))
    number = F.conv(F.substr(F.md5(row.cast("binary")), F.lit(1), F.lit(15)), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.sum(number).cast("string").alias("hash"))


def trade_log(orders: DataFrame, signals: DataFrame, by: list[str], key: str = "Company") -> DataFrame:
    return orders.join(signals, [*by, key], "left")


def drawdown_breaker(curve: DataFrame, by: list[str], most: float = 0.05, date: str = "Date") -> DataFrame:
    """curve with peak, drawdown and halted: once the drawdown has reached `most` it stays halted."""
    w = Window.partitionBy(*by).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    out = drawdowns(curve, by, date)
    return out.withColumn("halted", F.max((F.col("drawdown") <= -most).cast("int")).over(w) == 1)
