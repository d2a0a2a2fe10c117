"""Queries of feature columns (d), each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import features as X
from barloom.plans import views as V
from barloom.plans.views import oracle

R = lambda c, n=6: F.round(c, n)


def _columns(view, make):
    return lambda s, d: view(s, d).select("Company", "Date", *(R(v).alias(k) for k, v in make().items()))


def _simple(make):
    return _columns(V.series, make)


W = "WINDOW w AS (PARTITION BY Company ORDER BY Date)"
FR = "OVER (PARTITION BY Company ORDER BY Date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


def _sql(**columns: str) -> str:
    return "SELECT Company, Date, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in columns.items()) + f" FROM series {W}"


def _with_return(s, d):
    return V.series(s, d).withColumns({"ret": X.lag_return("px", 1), "ret5": X.lag_return("px", 5), "vol10": X.rolling_volatility("px", 10), "ratio": X.volume_ratio("vol")})


RET = f"SELECT *, (px - lag(px) OVER w) / nullif(lag(px) OVER w, 0) AS ret, (px - lag(px, 5) OVER w) / nullif(lag(px, 5) OVER w, 0) AS ret5, stddev_samp(px) {FR.format(10)} AS vol10, vol / nullif(avg(vol) {FR.format(5)}, 0) AS ratio FROM series {W}"


def _d7(s, d):
    return _with_return(s, d).select("Company", "Date", R(X.vol_adjusted_return("ret5", "vol10")).alias("x"))


def _d9(s, d):
    rows = _with_return(s, d).join(V.companies(s, d).select(F.col("Symbol").alias("Company"), "Sector"), "Company")
    return rows.select("Company", "Date", R(X.group_mean_by_date("ret5", "Sector")).alias("sector_mean"))


def _d10(s, d):
    return _with_return(s, d).select("Company", "Date", *(R(X.cross_section_rank(c)).alias(f"rank_{c}") for c in ("ret", "ret5", "vol10", "ratio", "px")))


def _d12(s, d):
    return X.rsi(V.series(s, d), "px").select("Company", "Date", R("rsi", 4).alias("rsi"))


MOVES = f"SELECT Company, Date, row_number() OVER w AS n, px - lag(px) OVER w AS m FROM series {W}"
D12 = """SELECT a.Company, a.Date, CASE WHEN a.n < 15 THEN 50.0 ELSE round(100 - 100 / (1 + sum(pow(13.0/14, a.n - b.n) * greatest(b.m, 0)) / CASE WHEN sum(greatest(-b.m, 0)) = 0 THEN 1e-9 * sum(pow(13.0/14, a.n - b.n)) ELSE sum(pow(13.0/14, a.n - b.n) * greatest(-b.m, 0)) END), 4) END AS rsi
 FROM moves a JOIN moves b ON b.Company = a.Company AND b.n <= a.n AND (b.m IS NOT NULL OR a.n = 1) GROUP BY a.Company, a.Date, a.n"""


def _d13(s, d):
    return X.macd(V.series(s, d), "px").select("Company", "Date", R("macd").alias("macd"), R("macd_signal").alias("macd_signal"))


NUMBERED = f"SELECT Company, Date, px, row_number() OVER w AS n FROM series {W}"
EWM = """SELECT Company, n, Date, px::double AS f, px::double AS l, 0.0::double AS g FROM numbered WHERE n = 1 UNION ALL
 SELECT Company, n, Date, f, l, g * 0.8 + (f - l) * 0.2 FROM (SELECT x.Company, x.n, x.Date, e.f * (1 - 2.0/13) + x.px * (2.0/13) AS f, e.l * (1 - 2.0/27) + x.px * (2.0/27) AS l, e.g FROM ewm e JOIN numbered x ON x.Company = e.Company AND x.n = e.n + 1)"""


def _d16(s, d):
    out = X.live_features(V.series(s, d))
    return out.select("Company", "Date", *(R(c).alias(c) for c in out.columns[4:]))


D16 = f"""SELECT Company, Date, round(r1, 6) AS return_1d, round(r5, 6) AS return_5d, round(r10, 6) AS return_10d, round(m5, 6) AS vs_ma_5, round(m20, 6) AS vs_ma_20, round(vr, 6) AS volume_ratio, round(v5, 6) AS volatility_5d, round(v10, 6) AS volatility_10d,
 round(percent_rank() OVER (PARTITION BY Date ORDER BY r5), 6) AS rank_return_5d, round(percent_rank() OVER (PARTITION BY Date ORDER BY v10), 6) AS rank_volatility_10d FROM
 (SELECT Company, Date, coalesce((px - lag(px, 1) OVER w) / nullif(lag(px, 1) OVER w, 0), 0) AS r1, coalesce((px - lag(px, 5) OVER w) / nullif(lag(px, 5) OVER w, 0), 0) AS r5, coalesce((px - lag(px, 10) OVER w) / nullif(lag(px, 10) OVER w, 0), 0) AS r10,
 coalesce((px - avg(px) {FR.format(5)}) / nullif(avg(px) {FR.format(5)}, 0), 0) AS m5, coalesce((px - avg(px) {FR.format(20)}) / nullif(avg(px) {FR.format(20)}, 0), 0) AS m20, coalesce(vol / nullif(avg(vol) {FR.format(5)}, 0), 1) AS vr,
 coalesce(stddev_samp(px) {FR.format(5)}, 0) AS v5, coalesce(stddev_samp(px) {FR.format(10)}, 0) AS v10 FROM series {W})"""


def _d17(s, d):
    return _with_return(s, d).select("Company", "Date", R(X.adv_usd("px", "vol")).alias("adv_usd"), R(X.return_volatility("ret")).alias("ret_vol"))


def _index(make):
    return lambda s, d: V.index_series(s, d).select("Date", *(R(v).alias(k) for k, v in make().items()))


QUERIES = {
    "d1_lag_return": (_simple(lambda: {f"r{n}": X.lag_return("px", n) for n in (1, 5, 10, 20, 50)}), _sql(**{f"r{n}": f"(px - lag(px, {n}) OVER w) / nullif(lag(px, {n}) OVER w, 0)" for n in (1, 5, 10, 20, 50)})),
    "d2_price_vs_ma": (_simple(lambda: {f"m{n}": X.price_vs_ma("px", n) for n in (5, 20)}), _sql(**{f"m{n}": f"(px - avg(px) {FR.format(n)}) / nullif(avg(px) {FR.format(n)}, 0)" for n in (5, 20)})),
    "d3_stochastic": (_simple(lambda: {"k": X.stochastic("px")}), _sql(k=f"(px - min(px) {FR.format(20)}) / nullif(max(px) {FR.format(20)} - min(px) {FR.format(20)}, 0)")),
    "d4_volume_ratio": (_simple(lambda: {"ratio": X.volume_ratio("vol")}), _sql(ratio=f"vol / nullif(avg(vol) {FR.format(5)}, 0)")),
    "d5_rolling_volatility": (_simple(lambda: {f"v{n}": X.rolling_volatility("px", n) for n in (5, 10, 20)}), _sql(**{f"v{n}": f"stddev_samp(px) {FR.format(n)}" for n in (5, 10, 20)})),
    "d6_calendar": (lambda s, d: V.series(s, d).select("Company", "Date", X.day_of_week("Date").alias("dow"), F.month("Date").alias("month")), "SELECT Company, Date, dayofweek(Date) AS dow, month(Date) AS month FROM series"),
    "d7_vol_adjusted_return": (_d7, "SELECT Company, Date, round(ret5 / nullif(vol10, 0), 6) AS x FROM ret"),
    "d8_rolling_zscore": (_simple(lambda: {"z": X.rolling_zscore("vol")}), _sql(z=f"(vol - avg(vol) {FR.format(20)}) / nullif(stddev_samp(vol) {FR.format(20)}, 0)")),
    "d9_group_mean_by_date": (_d9, "SELECT Company, Date, round(avg(ret5) OVER (PARTITION BY Sector, Date), 6) AS sector_mean FROM ret JOIN companies ON Symbol = Company"),
    "d10_cross_section_rank": (_d10, "SELECT Company, Date, " + ", ".join(f"round(percent_rank() OVER (PARTITION BY Date ORDER BY {c} NULLS LAST), 6) AS rank_{c}" for c in ("ret", "ret5", "vol10", "ratio", "px")) + " FROM ret"),
    "d11_log_size": (lambda s, d: V.companies(s, d).select("Symbol", R(X.log_size("MarketCap")).alias("log_size")), "SELECT Symbol, round(CASE WHEN MarketCap > 0 THEN log10(MarketCap) END, 6) AS log_size FROM companies"),
    "d12_rsi": (_d12, D12),
    "d13_macd": (_d13, "SELECT Company, Date, round(f - l, 6) AS macd, round(g, 6) AS macd_signal FROM ewm"),
    "d14_bollinger_width": (_simple(lambda: {"width": X.bollinger_width("px")}), _sql(width=f"CASE WHEN count(px) {FR.format(19)} >= 20 THEN coalesce(4 * stddev_samp(px) {FR.format(19)} / CASE WHEN avg(px) {FR.format(19)} = 0 THEN 1e-9 ELSE avg(px) {FR.format(19)} END, 0) ELSE 0 END")),
    "d15_lag_feature": (lambda s, d: _with_return(s, d).select("Company", "Date", *(R(X.lag_feature("ret", k, 0.0)).alias(f"ret_lag{k}") for k in (1, 2, 5)), R(X.lag_feature("ratio", 1, 1.0)).alias("ratio_lag1")), f"SELECT Company, Date, round(coalesce(lag(ret, 1) OVER w, 0), 6) AS ret_lag1, round(coalesce(lag(ret, 2) OVER w, 0), 6) AS ret_lag2, round(coalesce(lag(ret, 5) OVER w, 0), 6) AS ret_lag5, round(coalesce(lag(ratio, 1) OVER w, 1), 6) AS ratio_lag1 FROM ret {W}"),
    "d16_live_features": (_d16, D16),
    "d17_adv_and_return_volatility": (_d17, f"SELECT Company, Date, round(coalesce(avg(px * vol) {FR.format(20)}, 1e6), 6) AS adv_usd, round(coalesce(stddev_samp(ret) {FR.format(20)}, 0.01), 6) AS ret_vol FROM ret"),
    "d18_sma": (_index(lambda: {"sma": X.full_window(F.avg, "px", 50, [])}), "SELECT Date, round(CASE WHEN count(px) OVER f >= 50 THEN avg(px) OVER f END, 6) AS sma FROM index_series WINDOW f AS (ORDER BY Date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"),
    "d19_log_return": (_index(lambda: {"r": X.log_return("px", [])}), "SELECT Date, round(ln(px / lag(px) OVER (ORDER BY Date)), 6) AS r FROM index_series"),
    "d20_pct_change": (_index(lambda: {"r": X.pct_change("px", [])}), "SELECT Date, round(px / lag(px) OVER (ORDER BY Date) - 1, 6) AS r FROM index_series"),
    "d21_rolling_return_volatility": (lambda s, d: V.index_series(s, d).withColumn("r", X.pct_change("px", [])).select("Date", R(X.full_window(F.stddev_samp, "r", 20, [])).alias("v")), "SELECT Date, round(CASE WHEN count(r) OVER f >= 20 THEN stddev_samp(r) OVER f END, 6) AS v FROM (SELECT Date, px / lag(px) OVER (ORDER BY Date) - 1 AS r FROM index_series) WINDOW f AS (ORDER BY Date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"),
    "d22_volume_pressure": (_simple(lambda: {"p": X.volume_pressure("vol")}), "SELECT Company, Date, round(vol / nullif(avg(vol) OVER (PARTITION BY Company), 0), 6) AS p FROM series"),
    "d23_rank_pct": (_simple(lambda: {"r": X.rank_pct("vol", "Date")}), "SELECT Company, Date, round((rank() OVER (PARTITION BY Date ORDER BY vol) + (count(*) OVER (PARTITION BY Date, vol) - 1) / 2.0) / count(*) OVER (PARTITION BY Date), 6) AS r FROM series"),
    "d24_latest_row_per_key": (lambda s, d: X.latest_row_per_key(V.series(s, d)), "SELECT Company, Date, px, vol FROM (SELECT *, row_number() OVER (PARTITION BY Company ORDER BY Date DESC) AS n FROM series) WHERE n = 1"),
    "d25_first_value_per_date": (lambda s, d: X.first_value_per_date(V.series(s, d), "px", "Company"), "SELECT Date, min_by(px, Company) AS px FROM series GROUP BY Date"),
}
MORE = {"ret": RET, "moves": MOVES, "numbered": NUMBERED, "ewm": EWM}
ORACLES = {k: oracle(sql, **MORE) for k, (_, sql) in QUERIES.items() if sql}
