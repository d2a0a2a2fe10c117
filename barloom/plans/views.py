"""The tables that the registered queries work on, derived from the given ones, with the SQL of each for the oracle side."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _week(c: str):
    return F.date_trunc("week", F.col(c)).cast("date")


def _bars(rows: DataFrame, order: list[str]) -> DataFrame:
    """Open, high, low, close and volume of rows (Company, Date, p, q) in the given order."""
    at = F.struct(*order)
    return rows.groupBy("Company", "Date").agg(
        F.min_by("p", at).alias("Open"), F.max("p").alias("High"), F.min("p").alias("Low"), F.max_by("p", at).alias("Close"), F.sum("q").alias("Volume")
    )


def bars(spark: SparkSession, d: str, together: bool = False) -> DataFrame:
    """Weekly bars of each supplier's line prices; `together` where windows along a company follow, so that its lines move once."""
    lines = table(spark, d, "lineitem").withColumns({"Company": F.col("l_suppkey"), "Date": _week("l_shipdate"), "p": F.col("l_extendedprice") / F.col("l_quantity"), "q": F.col("l_quantity")})
    return _bars(lines.repartition("Company") if together else lines, ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"])


def calendar(spark: SparkSession, d: str) -> DataFrame:
    """The dates of bars: weeks of the lines, each once, without making bars of them."""
    return table(spark, d, "lineitem").select(_week("l_shipdate").alias("Date")).distinct()


def ticks_daily(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars of each user's event values."""
    rows = table(spark, d, "events").withColumns({"Company": F.col("user_id"), "Date": F.date_trunc("day", "ts").cast("date"), "p": F.col("value"), "q": F.lit(1.0)})
    return _bars(rows, ["ts", "event_id"])


def fx(spark: SparkSession, d: str) -> DataFrame:
    """Two rates by week: urgent orders that are partly shipped are their quotes, and some weeks have none."""
    o = table(spark, d, "orders").where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'")
    return o.groupBy(_week("o_orderdate").alias("Date")).agg((F.max("o_totalprice") / 100000.0).alias("EUR"), (F.min("o_totalprice") / 1000.0).alias("JPY"))


def companies(spark: SparkSession, d: str) -> DataFrame:
    """A listing: each supplier with the commonest type and brand of what it ships."""
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_brand"), "l_partkey")
    counts = lines.groupBy("l_suppkey", "p_type", "p_brand").count()

    def commonest(c: str, name: str) -> DataFrame:
        n = counts.groupBy("l_suppkey", c).agg(F.sum("count").alias("n"))
        return n.groupBy(F.col("l_suppkey").alias("Symbol")).agg(F.min_by(c, F.struct(-F.col("n"), c)).alias(name))

    where = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    listed = table(spark, d, "supplier").join(where, F.col("s_nationkey") == F.col("n_nationkey")).withColumn("Symbol", F.col("s_suppkey"))
    listed = listed.join(commonest("p_type", "Sector"), "Symbol", "left").join(commonest("p_brand", "Industry"), "Symbol", "left")
    return listed.select("Symbol", F.col("s_name").alias("Name"), "Sector", "Industry", F.col("n_name").alias("Country"), F.col("r_name").alias("Region"), F.col("s_acctbal").alias("MarketCap"))


def borders(spark: SparkSession, d: str) -> DataFrame:
    a, b = (table(spark, d, "nation").select(F.col("n_name").alias(n), "n_regionkey", F.col("n_nationkey").alias(f"{n}_key")) for n in ("country", "neighbour"))
    return a.join(b, "n_regionkey").where("abs(country_key - neighbour_key) = 5").select("country", "neighbour")


def tensions(spark: SparkSession, d: str) -> DataFrame:
    """Nations with the next one by key, where the two are of different regions."""
    n = table(spark, d, "nation")
    a = n.select(F.col("n_name").alias("country"), ((F.col("n_nationkey") + 1) % 25).alias("k"), F.col("n_regionkey").alias("_r"))
    return a.join(n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("rival"), "n_regionkey"), "k").where("_r <> n_regionkey").select("country", "rival")


def macro(spark: SparkSession, d: str) -> DataFrame:
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    joined = n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.groupBy(F.col("n_name").alias("country")).agg((F.max(F.when(F.col("n_nationkey") % 7 != 6, F.col("c_acctbal"))) * 1000000000.0).alias("gdp_usd"))


def acquisitions(spark: SparkSession, d: str) -> DataFrame:
    """Deals: what a returned line of the largest quantity and discount is taken for. Not every company has one."""
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity = 50 and l_discount >= 0.08")
    return lines.select(F.col("l_suppkey").alias("Symbol"), F.col("l_partkey").alias("acquired"), F.year("l_shipdate").alias("yr"), F.when(F.col("l_tax") > 0.02, F.col("l_extendedprice")).alias("price"))


def index_series(spark: SparkSession, d: str) -> DataFrame:
    return bars(spark, d).groupBy("Date").agg(F.round(F.avg("Close"), 6).alias("px"))


def raw_listing(spark: SparkSession, d: str) -> DataFrame:
    """companies with a row without name and one without symbol."""
    c = companies(spark, d)
    bad = spark.sql("select cast(-1 as bigint) as Symbol, cast(null as string) as Name, 'X' as Sector, 'Y' as Industry, 'Z' as Country, 'W' as Region, -5.0D as MarketCap union all select null, 'nameless', 'X', 'Y', 'Z', 'W', 10.0D")
    return c.unionByName(bad)


def series(spark: SparkSession, d: str) -> DataFrame:
    """ticks_daily as (Company, Date, px, vol), the input of feature columns."""
    return ticks_daily(spark, d).select("Company", "Date", F.col("Close").alias("px"), F.col("Volume").alias("vol"))


def scores(spark: SparkSession, d: str, also: dict[str, Column] | None = None) -> DataFrame:
    """Three models' scores of bars: ranks within a date of three features, with the realised rank as truth.

    also: further columns, of all bars (Company, Date, px, vol) and windows along a company.
    """
    w = Window.partitionBy("Company").orderBy("Date")
    b = bars(spark, d, together=True).select("Company", "Date", F.col("Close").alias("px"), F.col("Volume").alias("vol"))
    ahead = F.lead("px", 7).over(w)
    b = b.withColumns({**(also or {}), "r5": F.col("px") / F.lag("px", 5).over(w) - 1, "v": F.col("vol"), "hl": F.lag("px", 1).over(w), "ret": (ahead / F.col("px") - 1) * 100})
    b = b.where("r5 is not null and ret is not null")
    by = lambda c: F.percent_rank().over(Window.partitionBy("Date").orderBy(c, "Company"))
    return b.select("Company", "Date", *(also or {}), F.col("ret"), by("r5").alias("m1"), by("v").alias("m2"), by("hl").alias("m3"), by("ret").alias("truth"))


def model_rows(spark: SparkSession, d: str) -> DataFrame:
    """scores with the first places of the company's vector (0 without one)."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("Company"), *(F.get("embedding", F.lit(i)).cast("double").alias(f"e{i + 1}") for i in range(3)))
    return scores(spark, d).join(v, "Company", "left").na.fill(0.0, ["e1", "e2", "e3"])


#: SQL of each view, for the oracle side.
VIEWS = {
    "bars": """SELECT k AS Company, d AS Date, max(CASE WHEN ra=1 THEN p END) AS Open, max(p) AS High, min(p) AS Low, max(CASE WHEN rd=1 THEN p END) AS Close, sum(q) AS Volume FROM
 (SELECT l_suppkey AS k, CAST(date_trunc('week', l_shipdate) AS DATE) AS d, l_extendedprice/l_quantity AS p, l_quantity AS q,
 row_number() OVER (PARTITION BY l_suppkey, CAST(date_trunc('week', l_shipdate) AS DATE) ORDER BY l_shipdate,l_orderkey,l_linenumber,l_partkey,l_extendedprice,l_quantity) AS ra,
 row_number() OVER (PARTITION BY l_suppkey, CAST(date_trunc('week', l_shipdate) AS DATE) ORDER BY l_shipdate DESC,l_orderkey DESC,l_linenumber DESC,l_partkey DESC,l_extendedprice DESC,l_quantity DESC) AS rd
 FROM lineitem) GROUP BY k, d""",
    "ticks_daily": """SELECT user_id AS Company, d AS Date, max(CASE WHEN ra=1 THEN value END) AS Open, max(value) AS High, min(value) AS Low, max(CASE WHEN rd=1 THEN value END) AS Close, CAST(count(*) AS DOUBLE) AS Volume FROM
 (SELECT user_id, CAST(date_trunc('day', ts) AS DATE) AS d, value,
 row_number() OVER (PARTITION BY user_id, CAST(date_trunc('day', ts) AS DATE) ORDER BY ts, event_id) AS ra,
 row_number() OVER (PARTITION BY user_id, CAST(date_trunc('day', ts) AS DATE) ORDER BY ts DESC, event_id DESC) AS rd FROM events) GROUP BY user_id, d""",
    "fx": """SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS Date, max(o_totalprice)/100000.0 AS EUR, min(o_totalprice)/1000.0 AS JPY
FROM orders WHERE o_orderstatus='P' AND o_orderpriority='1-URGENT' GROUP BY CAST(date_trunc('week', o_orderdate) AS DATE)""",
    "listing_counts": "SELECT l_suppkey, p_type, p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY l_suppkey,p_type,p_brand",
    "companies": """SELECT s_suppkey AS Symbol, s_name AS Name, s.p_type AS Sector, i.p_brand AS Industry, n_name AS Country, r_name AS Region, s_acctbal AS MarketCap
FROM supplier LEFT JOIN (SELECT l_suppkey, p_type, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(n) DESC, p_type) AS r FROM listing_counts GROUP BY l_suppkey,p_type) s ON s.l_suppkey=s_suppkey AND s.r=1
 LEFT JOIN (SELECT l_suppkey, p_brand, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(n) DESC, p_brand) AS r FROM listing_counts GROUP BY l_suppkey,p_brand) i ON i.l_suppkey=s_suppkey AND i.r=1
 JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey""",
    "borders": "SELECT a.n_name AS country, b.n_name AS neighbour FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND abs(a.n_nationkey - b.n_nationkey) = 5",
    "tensions": "SELECT a.n_name AS country, b.n_name AS rival FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey + 1) % 25 WHERE a.n_regionkey <> b.n_regionkey",
    "macro": "SELECT n_name AS country, max(CASE WHEN n_nationkey % 7 <> 6 THEN c_acctbal END) * 1000000000.0 AS gdp_usd FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name",
    "acquisitions": "SELECT l_suppkey AS Symbol, l_partkey AS acquired, year(l_shipdate) AS yr, CASE WHEN l_tax > 0.02 THEN l_extendedprice END AS price FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50 AND l_discount >= 0.08",
    "index_series": "SELECT Date, round(avg(Close), 6) AS px FROM bars GROUP BY Date",
    "raw_listing": "SELECT * FROM companies UNION ALL SELECT -1, NULL, 'X', 'Y', 'Z', 'W', -5.0 UNION ALL SELECT NULL, 'nameless', 'X', 'Y', 'Z', 'W', 10.0",
    "series": "SELECT Company, Date, Close AS px, Volume AS vol FROM ticks_daily",
    "scores": """SELECT Company, Date, ret, percent_rank() OVER (PARTITION BY Date ORDER BY r5, Company) AS m1, percent_rank() OVER (PARTITION BY Date ORDER BY v, Company) AS m2,
 percent_rank() OVER (PARTITION BY Date ORDER BY hl, Company) AS m3, percent_rank() OVER (PARTITION BY Date ORDER BY ret, Company) AS truth FROM
 (SELECT Company, Date, Close / lag(Close, 5) OVER w - 1 AS r5, Volume AS v, lag(Close, 1) OVER w AS hl, (lead(Close, 7) OVER w / Close - 1) * 100 AS ret FROM bars WINDOW w AS (PARTITION BY Company ORDER BY Date))
 WHERE r5 IS NOT NULL AND ret IS NOT NULL""",
    "model_rows": "SELECT s.*, coalesce(embedding[1]::double, 0) AS e1, coalesce(embedding[2]::double, 0) AS e2, coalesce(embedding[3]::double, 0) AS e3 FROM scores s LEFT JOIN embeddings ON vec_id = Company",
}

#: Common tables that are computed once for a statement, however often it names them.
ONCE = {"scores", "rr_learn", "rr_scaled", "rr_gram", "rr_inverse", "rr_best", "oof"}


def oracle(body: str, **more: str) -> str:
    """body with the views it names, and further common tables, in front; in the order in which they build on each other."""
    known = VIEWS | more
    needed: list[str] = []

    def add(text: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b{name}\b", text) and known[name] is not text:
                add(known[name])
                if name not in needed:
                    needed.append(name)

    add(body)
    ctes = ", ".join(f"{n} AS {'MATERIALIZED ' if n in ONCE else ''}({known[n]})" for n in needed)
    return f"WITH RECURSIVE {ctes} {body}" if ctes else body
