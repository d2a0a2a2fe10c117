"""Joins, fills and labels that turn cleaned tables into one fact table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.ranges import last_known

#: Legal suffixes that a name loses, in this order, wherever they stand.
SUFFIXES = [" inc.", " inc", " corp.", " corp", " ltd.", " ltd", " plc", " co.", " co", " group", " holdings", " corporation"]
#: Country names that stand for others.
COUNTRY_ALIASES = {"United States": "United States of America", "UK": "United Kingdom"}


def series_window(key: str = "Company", date: str = "Date") -> Window:
    return Window.partitionBy(key).orderBy(date)


def trading_calendar(bars: DataFrame, date: str = "Date") -> DataFrame:
    return bars.select(date).distinct()


def fill_rates(calendar: DataFrame, rates: DataFrame, columns: list[str], date: str = "Date") -> DataFrame:
    """Each calendar date with its rates: exact, else the last before, else the first after.

    The calendar alone is ordered as a whole: one row a date.
    """
    joined = calendar.join(rates, date, "left")
    back = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    on = Window.orderBy(date).rowsBetween(0, Window.unboundedFollowing)
    return joined.select(date, *(F.coalesce(c, F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(on)).alias(c) for c in columns))


def default_rate(df: DataFrame, rates: DataFrame, column: str, default: float = 0.92, date: str = "Date") -> DataFrame:
    return df.join(rates.select(date, column), date, "left").withColumn(column, F.coalesce(F.col(column), F.lit(default)))


def forward_price(h: int, price: str = "Close", key: str = "Company", date: str = "Date") -> Column:
    return F.lead(price, h).over(series_window(key, date))


def forward_return_pct(ahead: str, price: str) -> Column:
    return (F.col(ahead) - F.col(price)) / F.nullif(F.col(price), F.lit(0.0)) * 100


def tradeable(price: str, ahead: Iterable[str], least: float = 1.0, least_ahead: float = 0.5) -> Column:
    kept = F.col(price) >= least
    for c in ahead:
        kept = kept & (F.col(c) >= least_ahead)
    return kept


def clip(c: str | Column, low: float, high: float) -> Column:
    """Missing values stay missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(c, F.lit(high))))


def direction_label(ret: str, threshold: float) -> Column:
    return F.when(F.col(ret) > threshold, 1).otherwise(0)


def rank_target(ret: str, date: str = "Date") -> Column:
    return F.percent_rank().over(Window.partitionBy(date).orderBy(F.col(ret).asc_nulls_last()))


def build_master(bars: DataFrame, rates: DataFrame, listing: DataFrame, horizons: tuple[int, int] = (7, 30), least: float = 1.0, least_ahead: float = 0.5, thresholds: tuple[float, float] = (0.5, 1.5)) -> DataFrame:
    """The fact table: forward returns clipped to [-100, 200], labels, rates of the day, listing columns and rank target."""
    short, long = horizons
    rows = bars.select("Company", "Date", F.col("Close").alias("close"), F.col("Volume").alias("volume"))
    rows = rows.withColumns({"ahead_short": forward_price(short, "close"), "ahead_long": forward_price(long, "close")})
    rows = rows.where(tradeable("close", ["ahead_short", "ahead_long"], least, least_ahead))
    rows = rows.withColumns({"ret_short": clip(forward_return_pct("ahead_short", "close"), -100.0, 200.0), "ret_long": clip(forward_return_pct("ahead_long", "close"), -100.0, 200.0)})
    filled = fill_rates(trading_calendar(bars), rates, ["EUR", "JPY"])
    joined = rows.join(filled, "Date").join(listing.select(F.col("Symbol").alias("Company"), "Sector", "Industry", "MarketCap"), "Company")
    return joined.select(
        "Company", "Date", "close", "volume", "EUR", "JPY", "Sector", "Industry", "MarketCap", "ret_short", direction_label("ret_short", thresholds[0]).alias("up_short"),
        "ret_long", direction_label("ret_long", thresholds[1]).alias("up_long"), rank_target("ret_long").alias("rank_target"),
    )


def company_base(listing: DataFrame, traded: DataFrame, members: DataFrame, columns: list[str], key: str = "Symbol") -> DataFrame:
    """Listed companies that trade; a member's value wins over the listing's."""
    kept = listing.join(traded.select(key).distinct(), key, "left_semi")
    joined = kept.alias("l").join(members.select(key, *columns).alias("m"), key, "left")
    return joined.select(key, *(F.coalesce(F.col(f"m.{c}"), F.col(f"l.{c}")).alias(c) for c in columns))


def intraday_volatility(bars: DataFrame, key: str = "Company") -> DataFrame:
    return bars.groupBy(key).agg((F.stddev_samp((F.col("Close") - F.col("Open")) / F.nullif(F.col("Open"), F.lit(0.0))) * 100).alias("volatility"))


def size_class(cap: str, steps: tuple[float, float, float] = (2e11, 1e10, 2e9)) -> Column:
    c = F.col(cap)
    return F.when(c.isNull(), "Unknown_Size").when(c >= steps[0], "Mega_Cap").when(c >= steps[1], "Large_Cap").when(c >= steps[2], "Mid_Cap").otherwise("Small_Cap")


def volatility_class(vol: str, steps: tuple[float, float] = (1.5, 3.0)) -> Column:
    c = F.col(vol)
    return F.when(c.isNull(), "Unknown_Volatility").when(c < steps[0], "Low_Volatility").when(c < steps[1], "Medium_Volatility").otherwise("High_Volatility")


def normalise_name(c: str | Column) -> Column:
    """Lower case, trimmed, without legal suffixes."""
    out = F.trim(F.lower(F.col(c) if isinstance(c, str) else c))
    for s in SUFFIXES:
        out = F.replace(out, F.lit(s), F.lit(""))
    return F.trim(out)


def latest_per_key(df: DataFrame, key: str, by: str, *ties: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(by).desc_nulls_last(), *ties)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def resolve_country(df: DataFrame, ranking: DataFrame, default: str = "United States") -> DataFrame:
    """Country of each row: its own, else that of the ranked company of like name, else the default; blanks and 'None' are missing."""
    own = F.nullif(F.nullif(F.trim("Country"), F.lit("")), F.lit("None"))
    named = latest_per_key(ranking.withColumn("_name", normalise_name("company")), "_name", "publish_year", "company").where("country is not null").select("_name", F.col("country").alias("_ranked"))
    joined = df.withColumns({"_own": own, "_name": normalise_name("Name")}).join(named, "_name", "left")
    return joined.withColumn("Country", F.coalesce("_own", "_ranked", F.lit(default))).select(df.columns)


def border_names(df: DataFrame, codes: DataFrame) -> DataFrame:
    """(country, borders): border code arrays as sorted name arrays; unknown codes are dropped."""
    each = df.select("country", F.explode("codes").alias("code")).join(codes, "code")
    return each.groupBy("country").agg(F.array_sort(F.collect_list("name")).alias("borders"))


def country_attributes(df: DataFrame, attributes: DataFrame, columns: list[str], country: str = "Country") -> DataFrame:
    """df with attributes of its country under known aliases; missing ones are Unknown_<column>."""
    name = F.col(country)
    for alias, full in COUNTRY_ALIASES.items():
        name = F.when(F.col(country) == alias, full).otherwise(name)
    joined = df.withColumn("_c", name).join(attributes.withColumnRenamed(country, "_c"), "_c", "left").drop("_c")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(f"Unknown_{c}")) for c in columns})


def attach_indicators(countries: DataFrame, long: DataFrame, names: list[str], key: str = "iso3") -> DataFrame:
    """Indicator rows (key, indicator, value) as columns beside the countries; missing ones are null."""
    return countries.join(long.groupBy(key).pivot("indicator", names).agg(F.max("value")), key, "left")


def attach_macro(df: DataFrame, countries: DataFrame, macro: DataFrame) -> DataFrame:
    """df by Symbol with the macro columns of its country; the country itself goes."""
    return df.join(countries.select("Symbol", F.col("Country").alias("country")), "Symbol", "left").join(macro, "country", "left").drop("country")


#: What each measure moves from and to in the course of a year, and over how many months; 0 is any other year.
MACRO_YEARS = {
    "interest_rate_pct": {2023: (4.33, 5.33, 8), 2025: (4.33, 3.5, 12), 0: (3.5, 3.3, 12)},
    "inflation_pct": {2023: (6.4, 3.4, 12), 2024: (3.4, 2.6, 12), 2025: (2.6, 2.2, 12), 0: (2.1, 2.1, 12)},
    "gdp_growth_pct": {2023: (2.0, 2.5, 12), 2024: (2.5, 2.8, 12), 2025: (2.2, 2.0, 12), 0: (2.0, 2.0, 12)},
    "gdp_usd": {2023: (26.8e12, 27.9e12, 12), 2024: (28.0e12, 29.2e12, 12), 2025: (29.3e12, 30.4e12, 12), 0: (30.6e12, 30.6e12, 12)},
}
#: The interest rate of 2024 from a month on.
RATE_2024 = {1: 5.33, 9: 4.83, 11: 4.58, 12: 4.33}


def pit_macro(date: str, lag_days: int = 45) -> dict[str, Column]:
    """Macro values that are known at a date: those of lag_days before, by the schedule above."""
    known = F.date_sub(F.col(date), lag_days)
    year, month = F.year(known), F.month(known)
    out = {}
    for name, years in MACRO_YEARS.items():
        line = lambda a, b, n: F.lit(float(a)) + F.lit(float(b - a)) * F.least(month / n, F.lit(1.0))
        value = line(*years[0])
        for y, ends in years.items():
            if y:
                value = F.when(year == y, line(*ends)).otherwise(value)
        if name == "interest_rate_pct":
            step = F.lit(RATE_2024[1])
            for m, rate in RATE_2024.items():
                step = F.when(month >= m, rate).otherwise(step)
            value = F.when(year == 2024, step).otherwise(value)
        out[name] = value
    return out


def asof_latest(dates: DataFrame, observed: DataFrame, value: str, date: str = "Date", key: list[str] | None = None) -> DataFrame:
    """Each date (of each key) with the last value observed at or before it; of a date's values the largest.

    Dates and observations are one table in ranges of (key, date), so neither a key of very many dates nor a calendar
    without key is a task of its own; what a range has last is carried into the next ones.
    """
    key = key or []
    marked = observed.select(*key, date, F.col(value).alias("_v"), F.lit(0).alias("_asked")).unionByName(dates.select(*key, date).withColumns({"_v": F.lit(None).cast(observed.schema[value].dataType), "_asked": F.lit(1)}))
    return last_known(marked, "_v", key, [date, "_asked", "_v"], "_last").where("_asked = 1").select(*key, date, F.col("_last").alias(value))


def asof_with_tolerance(dates: DataFrame, observed: DataFrame, value: str, days: int = 3, default: float = 0.0, date: str = "Date", key: list[str] | None = None) -> DataFrame:
    """The value of the date itself or of at most days before it (of its key), else the default."""
    held = observed.withColumn("_s", F.struct(F.col(date).alias("_at"), F.col(value)))
    found = asof_latest(dates, held, "_s", date, key)
    return found.select(*(key or []), date, F.when(F.datediff(date, "_s._at") <= days, F.col(f"_s.{value}")).otherwise(default).alias(value))


def yoy_change(value: str, rows: int = 12, key: list[str] | None = None, date: str = "Date") -> Column:
    before = F.lag(value, rows).over(Window.partitionBy(*(key or [])).orderBy(date))
    return (F.col(value) / before - 1) * 100


def static_metadata(master: DataFrame) -> DataFrame:
    """One row per company: its constants, and the rates of its last date."""
    return master.groupBy("Company").agg(F.max("Sector").alias("Sector"), F.max("Industry").alias("Industry"), F.max("MarketCap").alias("MarketCap"), F.max_by("EUR", "Date").alias("EUR"), F.max_by("JPY", "Date").alias("JPY"))


#: Fixed values for missing metadata.
DEFAULTS = {"EUR": 1.0, "JPY": 155.0, "Sector": "Technology", "MarketCap": 5e10}


def fill_defaults(df: DataFrame, defaults: dict | None = None) -> DataFrame:
    return df.fillna({k: v for k, v in (defaults or DEFAULTS).items() if k in df.columns})


def business_days(df: DataFrame, start: str, end: str) -> DataFrame:
    """Weekdays between two date columns, both included."""
    return df.select(F.explode(F.sequence(F.col(start), F.col(end))).alias("Date")).where("weekday(Date) < 5").distinct()
