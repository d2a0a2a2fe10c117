"""Constraint sets over tables: named predicates that keep rows, their counts, and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = dict[str, Column]


def not_null(c: str) -> Column:
    return F.col(c).isNotNull()


def at_least(c: str, low: float) -> Column:
    """Missing values pass."""
    return F.col(c).isNull() | (F.col(c) >= low)


def at_most(c: str, high: float) -> Column:
    return F.col(c).isNull() | (F.col(c) <= high)


def listing_rules(year: str | None = None, last: int = 2026) -> Rules:
    rules = {"symbol": not_null("Symbol"), "name": not_null("Name"), "cap": at_least("MarketCap", 0)}
    return rules | ({"year": at_most(year, last)} if year else {})


def bar_rules() -> Rules:
    return {"date": not_null("Date"), "high_low": F.col("High") >= F.col("Low"), "volume": F.col("Volume") >= 0, "open": at_least("Open", 0), "close": at_least("Close", 0)}


def rate_rules() -> Rules:
    return {"date": not_null("Date"), "eur": F.col("EUR") > 0, "jpy": F.col("JPY") > 0}


def member_rules() -> Rules:
    return {"ticker": not_null("Symbol"), "name": not_null("Name"), "cap": at_least("MarketCap", 0), "employees": at_least("Employees", 0)}


def ranking_rules(last: int = 2026) -> Rules:
    return {"company": not_null("company"), "rank": F.col("rank") > 0, "year": at_most("publish_year", last)}


def acquisition_rules(parents: list, low: int = 1900, high: int = 2026) -> Rules:
    return {
        "parent": not_null("Symbol"), "acquired": not_null("acquired"), "known": F.col("Symbol").isin(parents),
        "year": F.col("yr").isNull() | F.col("yr").between(low, high), "price": at_least("price", 0),
    }


def _all(rules: Rules) -> Column:
    kept = F.lit(True)
    for rule in rules.values():
        kept = kept & rule
    return kept


def apply_rules(df: DataFrame, rules: Rules) -> DataFrame:
    """Rows for which every rule is true; a rule that is null for a row drops it. The schema stays."""
    return df.where(_all(rules))


def repeated_keys(df: DataFrame, raw: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Rows whose key occurs least times or more in raw."""
    return df.join(raw.groupBy(key).count().where(F.col("count") >= least).select(key), key, "left_semi")


def rules_text(rules: Rules) -> dict[str, str]:
    return {name: str(rule) for name, rule in rules.items()}


def quality_metrics(df: DataFrame, rules: Rules) -> DataFrame:
    """One row: raw, clean, removed and removal_rate as text ("0.00%"; "0%" for an empty table), in one pass."""
    n = df.agg(F.count("*").alias("raw"), F.count_if(F.coalesce(_all(rules), F.lit(False))).alias("clean"))
    removed = F.col("raw") - F.col("clean")
    rate = F.when(F.col("raw") == 0, "0%").otherwise(F.concat(F.format_string("%.2f", removed * 100.0 / F.col("raw")), F.lit("%")))
    return n.select("raw", "clean", removed.alias("removed"), rate.alias("removal_rate"))


def violations(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(table, violations, valid): null counts of the columns that must not be null."""
    parts = [df.agg(sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0)).alias("violations")).select(F.lit(name).alias("table_name"), "violations", (F.col("violations") == 0).alias("valid")) for name, (df, columns) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def range_profile(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table_name, min_date, max_date, n) of each table."""
    parts = [df.agg(F.min(c).alias("min_date"), F.max(c).alias("max_date"), F.count("*").alias("n")).withColumn("table_name", F.lit(name)) for name, (df, c) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fact_profile(df: DataFrame, key: str, value: str, label: str, rank: str) -> DataFrame:
    """One row over a fact table, in one aggregation."""
    return df.agg(
        F.count("*").alias("n"), F.countDistinct(key).alias("keys"), F.count(value).alias("present"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("sd"),
        F.round(F.avg(label), 6).alias("label_rate"), F.round(F.min(rank), 6).alias("rank_min"), F.round(F.max(rank), 6).alias("rank_max"),
    )
