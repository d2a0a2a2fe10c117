"""Queries of sources (a), quality (b) and integration (c), each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructType

from barloom.operators import integrate as I
from barloom.operators import quality as B
from barloom.plans import views as V
from barloom.plans.views import oracle
from barloom.sources import tables as A
from barloom.sources.scratch import release, shared_dir, written
from barloom.sources.versioned import VersionedTable

R = lambda c, n=6: F.round(c, n)


def _market(d_view):
    return lambda s, d: d_view(s, d)


def _ranking(s, d):
    """supplier names with suffixes, as a ranking of employers."""
    x = V.table(s, d, "supplier").join(V.table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    suffix = F.element_at(F.array(*map(F.lit, (" Inc.", " Corp", " PLC", ""))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    rows = x.select(F.concat("s_name", suffix).alias("company"), (F.col("s_suppkey") % 50).alias("rank"), (F.lit(2000) + F.col("s_suppkey") % 30).alias("publish_year"), F.when(F.col("s_suppkey") % 5 > 0, F.col("n_name")).alias("country"))
    return rows.unionByName(rows.withColumn("publish_year", F.col("publish_year") - 3))


RANKING = """SELECT s_name || CASE s_suppkey % 4 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' Corp' WHEN 2 THEN ' PLC' ELSE '' END AS company, s_suppkey % 50 AS rank, 2000 + s_suppkey % 30 - x.k AS publish_year,
 CASE WHEN s_suppkey % 5 > 0 THEN n_name END AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 3) x"""


def _master(s, d):
    return I.build_master(V.bars(s, d), V.fx(s, d), V.companies(s, d), least=250, least_ahead=125)


FILLED = """SELECT Date, coalesce(EUR, last_value(EUR IGNORE NULLS) OVER b, first_value(EUR IGNORE NULLS) OVER f) AS EUR, coalesce(JPY, last_value(JPY IGNORE NULLS) OVER b, first_value(JPY IGNORE NULLS) OVER f) AS JPY
 FROM (SELECT DISTINCT Date FROM bars) c LEFT JOIN fx USING (Date) WINDOW b AS (ORDER BY Date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (ORDER BY Date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""
MASTER = """SELECT Company, Date, close, volume, EUR, JPY, Sector, Industry, MarketCap, ret_short, CASE WHEN ret_short > 0.5 THEN 1 ELSE 0 END AS up_short, ret_long, CASE WHEN ret_long > 1.5 THEN 1 ELSE 0 END AS up_long,
 percent_rank() OVER (PARTITION BY Date ORDER BY ret_long NULLS LAST) AS rank_target FROM
 (SELECT Company, Date, close, volume, greatest(-100, least((a7 - close) / nullif(close, 0) * 100, 200)) AS ret_short, greatest(-100, least((a30 - close) / nullif(close, 0) * 100, 200)) AS ret_long FROM
  (SELECT Company, Date, Close AS close, Volume AS volume, lead(Close, 7) OVER w AS a7, lead(Close, 30) OVER w AS a30 FROM bars WINDOW w AS (PARTITION BY Company ORDER BY Date)) x
  WHERE close >= 250 AND a7 >= 125 AND a30 >= 125) y JOIN filled USING (Date) JOIN (SELECT Symbol AS Company, Sector, Industry, MarketCap FROM companies) l USING (Company)"""


def _a7v(s, d):
    """Bars loaded year by year into a versioned table, one merge a year, and read back."""
    bars = written(V.bars(s, d).select("Company", "Date", R("Close").alias("Close"), F.year("Date").alias("load")))
    table = VersionedTable(s, shared_dir(s), bars.schema)
    for y in sorted(r["load"] for r in bars.select("load").distinct().collect()):
        table.merge(bars.where(F.col("load") == y), y)
    table.clear(keep=1)
    release(bars)
    return table.read()


def _members(s, d):
    """Companies that have a label: some of them, at every scale."""
    labelled = V.table(s, d, "labels").select(F.col("doc_id").alias("Symbol")).distinct()
    return V.companies(s, d).join(labelled, "Symbol", "left_semi").select("Symbol", F.upper("Name").alias("Name"), "Sector", (F.col("MarketCap") * 2).alias("MarketCap"), (F.col("Symbol") * 10 - 50).alias("Employees"))


MEMBERS = "SELECT Symbol, upper(Name) AS Name, Sector, MarketCap * 2 AS MarketCap, Symbol * 10 - 50 AS Employees FROM companies WHERE Symbol IN (SELECT doc_id FROM labels)"


def _a3(s, d):
    return A.dates_to_text(V.table(s, d, "orders").select("o_orderkey", "o_orderdate"))


def _a4(s, d):
    schema = StructType().add("l_orderkey", LongType()).add("l_quantity", StringType()).add("l_returnflag", DoubleType()).add("l_linenumber", BooleanType()).add("absent", StringType())
    return A.conform(V.table(s, d, "lineitem"), schema)[0].groupBy("l_quantity", "l_returnflag", "l_linenumber", "absent").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


def _a5(s, d):
    text = V.table(s, d, "lineitem").select("l_suppkey", F.when(F.col("l_linenumber") % 3 == 0, "-").when(F.col("l_linenumber") % 3 == 1, "Undisclosed").otherwise(F.col("l_partkey").cast("string")).alias("price"))
    return A.coerce_numeric(text, ["price"]).groupBy("l_suppkey").agg(F.count("price").alias("priced"), F.sum("price").alias("total"))


def _loads(s, d):
    t = V.ticks_daily(s, d)
    old = t.where("Date < date '2024-01-20'").withColumn("load", F.lit(1))
    new = t.where("Date >= date '2024-01-15'").withColumn("Close", F.col("Close") + 1).withColumn("load", F.lit(2))
    return old, new.unionByName(new.where("Company % 3 = 0").withColumn("load", F.lit(3)).withColumn("Close", F.col("Close") + 5))


def _a7(s, d):
    return A.upsert_bars(*_loads(s, d)).select("Company", "Date", R("Close").alias("Close"), "load")


#: Companies of one wide row; each row has the columns of so many keys.
WIDE = 50


def _a8(s, d):
    """Wide rows of WIDE companies each, as a download of many tickers has them, made long again; of all companies."""
    t = V.ticks_daily(s, d).withColumns({"group": F.floor(F.col("Company") / WIDE), "slot": F.col("Company") % WIDE})
    wide = t.groupBy("group", "Date").agg(*(F.max(F.when(F.col("slot") == k, F.col(f))).alias(f"{f}_{k}") for k in range(WIDE) for f in ("Close", "Volume")))
    long = A.wide_to_long(wide, "Date", [str(k) for k in range(WIDE)], ["Close", "Volume"], ["group"])
    return long.select((F.col("group") * WIDE + F.col("ticker").cast("long")).cast("string").alias("ticker"), "Date", "Close", "Volume")


AWKWARD = ' "x"\\new\r\n\tC:\\temp é \\\\'


def _a12(s, d):
    none = F.lit(None).cast("string")
    t = V.companies(s, d).select(F.concat(F.lit("urn:c:"), "Symbol").alias("s"), F.lit("urn:p:name").alias("p"), F.concat("Name", F.lit(AWKWARD)).alias("o"), F.lit("literal").alias("o_kind"), none.alias("o_type"))
    t = t.unionByName(V.companies(s, d).select(F.concat(F.lit("urn:c:"), "Symbol").alias("s"), F.lit("urn:p:cap").alias("p"), F.col("MarketCap").cast("long").cast("string").alias("o"), F.lit("literal").alias("o_kind"), F.lit("xsd:integer").alias("o_type")))
    t = t.unionByName(V.companies(s, d).select(F.concat(F.lit("urn:c:"), "Symbol").alias("s"), F.lit("urn:p:in").alias("p"), F.concat(F.lit("urn:n:"), "Country").alias("o"), F.lit("iri").alias("o_kind"), none.alias("o_type")))
    path = shared_dir(s)
    A.write_triples(t, path)
    return A.read_triples(s, path)


def _back(s, d, write, read):
    path = shared_dir(s)
    write(path)
    return read(path)


def _a1(s, d):
    """Companies as CSV with a header, scanned with their schema."""
    t = V.companies(s, d)
    return _back(s, d, lambda p: A.write_results(t, p, "csv"), lambda p: A.scan_csv(s, p, t.schema))


def _a2(s, d):
    """A table replaced by another, partitioned."""
    t = V.companies(s, d).select("Symbol", "Name", "Region")
    return _back(s, d, lambda p: (A.write_table(t, p), A.write_table(t.where("Name is not null"), p, ["Region"])), lambda p: s.read.parquet(p).select(t.columns))


def _a6(s, d):
    found = A.check_inputs({"bars": V.bars(s, d), "fx": V.fx(s, d).where("false"), "members": None})
    return s.createDataFrame(sorted(found.items()), "name string, problem string")


def _a9(s, d):
    t = V.bars(s, d)
    return _back(s, d, lambda p: A.write_results(t, p, "json", ["Date"]), lambda p: s.read.schema("Company long, Close double, Date date").json(p).select("Company", "Date", R("Close").alias("Close")))


def _a10(s, d):
    t = V.fx(s, d).select("Date", R("EUR").alias("EUR"))
    return _back(s, d, lambda p: (A.append_log(t.where("EUR > 4"), p), A.append_log(t.where("EUR <= 4"), p)), lambda p: s.read.parquet(p))


def _a11(s, d):
    row = A.metrics_row(B.quality_metrics(V.companies(s, d), {"cap": F.col("MarketCap") > 0}), "listing")
    return row.select("metric_name", F.get_json_object("metric_value", "$.raw").cast("long").alias("raw"), F.get_json_object("metric_value", "$.clean").cast("long").alias("clean"))


def _a14(s, d):
    rows = V.macro(s, d).select(F.struct(F.col("country").alias("countryiso3code"), F.col("gdp_usd").alias("value")).alias("r"))
    text = rows.groupBy((F.substr("r.countryiso3code", F.lit(8), F.lit(1))).alias("k")).agg(F.concat(F.lit('[{"page":1},'), F.to_json(F.collect_list("r"), {"ignoreNullFields": "false"}), F.lit("]")).alias("value"))
    return A.indicator_rows(text)


def _edge(s, d):
    return V.borders(s, d), V.companies(s, d)


def _c19(s, d):
    n = V.table(s, d, "nation")
    codes = n.select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"))
    each = n.select(F.col("n_name").alias("country"), F.array(*(((F.col("n_nationkey") + k).cast("string")) for k in (1, 7, 20))).alias("codes"))
    return I.border_names(each, codes).withColumn("borders", F.array_join("borders", ","))


def _c21(s, d):
    n = V.table(s, d, "nation").select(F.col("n_name").alias("iso3"))
    c = V.table(s, d, "customer").join(V.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    long = c.groupBy(F.col("n_name").alias("iso3"), F.col("c_mktsegment").alias("indicator")).agg(F.max("c_acctbal").alias("value"))
    return I.attach_indicators(n, long, ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])


def _calendar(s, d):
    return V.bars(s, d).select("Date").distinct()


def _c24(s, d):
    days = _calendar(s, d).select(F.expr("make_date(2023 + month(Date) % 4, 1 + day(Date) % 12, 1 + day(Date) % 28)").alias("Date")).distinct()
    return days.select("Date", *(R(v).alias(k) for k, v in I.pit_macro("Date").items()))


C24 = """SELECT Date, round(CASE y WHEN 2023 THEN 4.33 + 1.0 * least(m / 8.0, 1.0) WHEN 2024 THEN CASE WHEN m < 9 THEN 5.33 WHEN m < 11 THEN 4.83 WHEN m = 11 THEN 4.58 ELSE 4.33 END WHEN 2025 THEN 4.33 - 0.83 * m / 12.0 ELSE 3.5 - 0.2 * m / 12.0 END, 6)::double AS interest_rate_pct,
 round(CASE y WHEN 2023 THEN 6.4 - 3.0 * m / 12.0 WHEN 2024 THEN 3.4 - 0.8 * m / 12.0 WHEN 2025 THEN 2.6 - 0.4 * m / 12.0 ELSE 2.1 END, 6)::double AS inflation_pct,
 round(CASE y WHEN 2023 THEN 2.0 + 0.5 * m / 12.0 WHEN 2024 THEN 2.5 + 0.3 * m / 12.0 WHEN 2025 THEN 2.2 - 0.2 * m / 12.0 ELSE 2.0 END, 6)::double AS gdp_growth_pct,
 round(CASE y WHEN 2023 THEN 26.8e12 + 1.1e12 * m / 12.0 WHEN 2024 THEN 28.0e12 + 1.2e12 * m / 12.0 WHEN 2025 THEN 29.3e12 + 1.1e12 * m / 12.0 ELSE 30.6e12 END, 6)::double AS gdp_usd
 FROM (SELECT Date, year(Date - 45) AS y, month(Date - 45)::double AS m FROM (SELECT DISTINCT make_date(2023 + month(Date) % 4, 1 + day(Date) % 12, 1 + day(Date) % 28) AS Date FROM bars))"""

ALIKE = "replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(trim(lower({})), ' inc.', ''), ' inc', ''), ' corp.', ''), ' corp', ''), ' ltd.', ''), ' ltd', ''), ' plc', ''), ' co.', ''), ' co', ''), ' group', ''), ' holdings', ''), ' corporation', '')"


def _c11(s, d):
    traded = V.acquisitions(s, d).select("Symbol")
    return I.company_base(V.companies(s, d), traded, _members(s, d), ["Name", "Sector", "MarketCap"])


def _c17(s, d):
    listed = V.companies(s, d).select("Symbol", "Name", F.when(F.col("Symbol") % 3 == 0, "").when(F.col("Symbol") % 7 == 0, "None").when(F.col("Symbol") % 2 == 0, F.col("Country")).alias("Country"))
    return I.resolve_country(listed, _ranking(s, d))


C17 = f"""SELECT Symbol, Name, coalesce(nullif(nullif(trim(c0), ''), 'None'), r.country, 'United States') AS Country FROM
 (SELECT Symbol, Name, CASE WHEN Symbol % 3 = 0 THEN '' WHEN Symbol % 7 = 0 THEN 'None' WHEN Symbol % 2 = 0 THEN Country END AS c0 FROM companies) l
 LEFT JOIN (SELECT nm, country FROM (SELECT trim({ALIKE.format('company')}) AS nm, country, row_number() OVER (PARTITION BY trim({ALIKE.format('company')}) ORDER BY publish_year DESC, company) AS r FROM ranking) WHERE r = 1 AND country IS NOT NULL) r ON r.nm = trim({ALIKE.format('l.Name')})"""


def _c20(s, d):
    n = V.table(s, d, "nation").join(V.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return I.country_attributes(V.raw_listing(s, d).select("Symbol", "Country"), n.select(F.col("n_name").alias("Country"), F.col("r_name").alias("region")), ["region"])


def _c22(s, d):
    from barloom.operators.graph import triples_to_wide

    return triples_to_wide(_macro_triples(s, d), ["gdp", "pop"])


def _macro_triples(s, d):
    m = V.macro(s, d)
    one = lambda p, o: m.select(F.concat(F.lit("urn:country:"), F.replace("country", F.lit("_"), F.lit("__"))).alias("s"), F.lit(f"urn:rel:{p}").alias("p"), o.alias("o"), F.lit("literal").alias("o_kind"), F.lit("xsd:float").alias("o_type"))
    return one("gdp", F.col("gdp_usd").cast("decimal(20,0)").cast("string")).unionByName(one("pop", F.when(F.length("country") > 8, F.length("country").cast("string")))).where("o is not null")


def _c25(s, d):
    fridays = _calendar(s, d).select((F.col("Date") + F.expr("interval 4 days")).cast("date").alias("Date"))
    return I.asof_latest(fridays, V.fx(s, d), "EUR")


def _c26(s, d):
    days = _calendar(s, d).select(F.expr("date_add(Date, day(Date) % 8)").alias("Date")).distinct()
    return I.asof_with_tolerance(days, V.index_series(s, d), "px")


def _c28(s, d):
    return I.static_metadata(_master(s, d))


def _c29(s, d):
    return I.fill_defaults(V.companies(s, d).select("Symbol", F.when(F.col("Symbol") % 2 == 0, F.col("Sector")).alias("Sector"), F.when(F.col("MarketCap") > 0, F.col("MarketCap")).alias("MarketCap")))


def _c30(s, d):
    return I.business_days(_calendar(s, d).agg(F.min("Date").alias("a"), F.max("Date").alias("b")), "a", "b")


FWD = "SELECT *, lead(Close, 7) OVER w AS a7, lead(Close, 14) OVER w AS a14 FROM ticks_daily WINDOW w AS (PARTITION BY Company ORDER BY Date)"


def _fwd(s, d):
    return V.ticks_daily(s, d).withColumns({"a7": I.forward_price(7), "a14": I.forward_price(14)})


def _b9(s, d):
    return B.quality_metrics(V.raw_listing(s, d), B.listing_rules())


QUERIES = {
    "a1_scan_csv": (_a1, "SELECT * FROM companies"),
    "a2_write_table": (_a2, "SELECT Symbol, Name, Region FROM companies WHERE Name IS NOT NULL"),
    "a6_check_inputs": (_a6, "SELECT 'fx' AS name, 'empty' AS problem UNION ALL SELECT 'members', 'missing'"),
    "a9_write_results": (_a9, "SELECT Company, Date, round(Close, 6) AS Close FROM bars"),
    "a10_append_log": (_a10, "SELECT Date, round(EUR, 6) AS EUR FROM fx"),
    "a11_metrics_row": (_a11, "SELECT 'listing' AS metric_name, count(*) AS raw, count(*) FILTER (MarketCap > 0) AS clean FROM companies"),
    "a3_dates_to_text": (_a3, "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders"),
    "a4_conform": (_a4, "SELECT CAST(l_quantity AS VARCHAR) AS l_quantity, TRY_CAST(l_returnflag AS DOUBLE) AS l_returnflag, CAST(l_linenumber AS BOOLEAN) AS l_linenumber, CAST(NULL AS VARCHAR) AS absent, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem GROUP BY ALL"),
    "a5_coerce_numeric": (_a5, "SELECT l_suppkey, count(p) AS priced, sum(p) AS total FROM (SELECT l_suppkey, TRY_CAST(CASE WHEN l_linenumber % 3 = 0 THEN '-' WHEN l_linenumber % 3 = 1 THEN 'Undisclosed' ELSE CAST(l_partkey AS VARCHAR) END AS DOUBLE) AS p FROM lineitem) GROUP BY l_suppkey"),
    "a7_upsert_bars": (_a7, """SELECT Company, Date, round(Close, 6) AS Close, load FROM (SELECT *, row_number() OVER (PARTITION BY Company, Date ORDER BY load DESC) AS n FROM (
 SELECT Company, Date, Close, 1 AS load FROM ticks_daily WHERE Date < DATE '2024-01-20' UNION ALL
 SELECT n.* FROM (SELECT Company, Date, Close + 1 AS Close, 2 AS load FROM ticks_daily WHERE Date >= DATE '2024-01-15' UNION ALL SELECT Company, Date, Close + 6, 3 FROM ticks_daily WHERE Date >= DATE '2024-01-15' AND Company % 3 = 0) n
 LEFT JOIN (SELECT Company, max(Date) AS m FROM ticks_daily WHERE Date < DATE '2024-01-20' GROUP BY Company) o ON o.Company = n.Company WHERE m IS NULL OR n.Date > m)) WHERE n = 1"""),
    "a7_versioned_merge": (_a7v, "SELECT Company, Date, round(Close, 6) AS Close, year(Date)::int AS load FROM bars"),
    "a8_wide_to_long": (_a8, "SELECT CAST(Company AS VARCHAR) AS ticker, Date, Close, Volume FROM ticks_daily"),
    "a12_triples_round_trip": (_a12, """SELECT 'urn:c:' || Symbol AS s, 'urn:p:name' AS p, Name || ' "x"\\new' || chr(13) || chr(10) || chr(9) || 'C:\\temp é \\\\' AS o, 'literal' AS o_kind, NULL AS o_type FROM companies UNION ALL SELECT 'urn:c:' || Symbol, 'urn:p:cap', CAST(CAST(trunc(MarketCap) AS BIGINT) AS VARCHAR), 'literal', 'xsd:integer' FROM companies UNION ALL SELECT 'urn:c:' || Symbol, 'urn:p:in', 'urn:n:' || Country, 'iri', NULL FROM companies"""),
    "a13_union_graphs": (lambda s, d: A.union_graphs(V.borders(s, d), V.tensions(s, d).withColumnRenamed("rival", "neighbour")), "SELECT * FROM borders UNION SELECT country, rival FROM tensions"),
    "a14_indicator_json": (_a14, "SELECT country AS iso3, gdp_usd AS value FROM macro WHERE gdp_usd IS NOT NULL"),
    "b1_listing_constraints": (lambda s, d: B.apply_rules(V.raw_listing(s, d), B.listing_rules()), "SELECT * FROM raw_listing WHERE Symbol IS NOT NULL AND Name IS NOT NULL AND (MarketCap >= 0 OR MarketCap IS NULL)"),
    "b2_bar_constraints": (lambda s, d: B.apply_rules(V.bars(s, d).withColumn("High", F.when(F.col("Company") % 9 == 0, F.col("Low") - 1).when(F.col("Company") % 10 > 0, F.col("High"))), B.bar_rules()), "SELECT * FROM (SELECT Company, Date, Open, CASE WHEN Company % 9 = 0 THEN Low - 1 WHEN Company % 10 > 0 THEN High END AS High, Low, Close, Volume FROM bars) WHERE High >= Low AND Volume >= 0"),
    "b3_repeated_keys": (lambda s, d: B.repeated_keys(V.ticks_daily(s, d).where("Close >= 5"), V.ticks_daily(s, d), "Company", 27), "SELECT * FROM ticks_daily WHERE Close >= 5 AND Company IN (SELECT Company FROM ticks_daily GROUP BY Company HAVING count(*) >= 27)"),
    "b4_rate_constraints": (lambda s, d: B.apply_rules(V.fx(s, d).withColumn("JPY", F.col("JPY") - 3), B.rate_rules()), "SELECT * FROM (SELECT Date, EUR, JPY - 3 AS JPY FROM fx) WHERE Date IS NOT NULL AND EUR > 0 AND JPY > 0"),
    "b5_member_constraints": (lambda s, d: B.apply_rules(_members(s, d), B.member_rules()), "SELECT * FROM members WHERE Symbol IS NOT NULL AND Name IS NOT NULL AND (MarketCap >= 0 OR MarketCap IS NULL) AND (Employees >= 0 OR Employees IS NULL)"),
    "b6_ranking_constraints": (lambda s, d: B.apply_rules(_ranking(s, d), B.ranking_rules(2025)), "SELECT * FROM ranking WHERE company IS NOT NULL AND rank > 0 AND (publish_year <= 2025 OR publish_year IS NULL)"),
    "b7_acquisition_constraints": (lambda s, d: B.apply_rules(V.acquisitions(s, d), B.acquisition_rules([1, 2, 4, 5, 7, 8], 1995, 2000)), "SELECT * FROM acquisitions WHERE Symbol IN (1, 2, 4, 5, 7, 8) AND (yr IS NULL OR yr BETWEEN 1995 AND 2000) AND (price >= 0 OR price IS NULL)"),
    "b9_quality_metrics": (_b9, "SELECT raw, clean, raw - clean AS removed, printf('%.2f%%', (raw - clean) * 100.0 / raw) AS removal_rate FROM (SELECT count(*) AS raw, count(*) FILTER (Symbol IS NOT NULL AND Name IS NOT NULL AND (MarketCap >= 0 OR MarketCap IS NULL)) AS clean FROM raw_listing)"),
    "b10_validate": (lambda s, d: B.violations({"listing": (V.raw_listing(s, d), ["Symbol", "Name"]), "bars": (V.bars(s, d), ["Date", "Close"])}), "SELECT 'listing' AS table_name, count(*) FILTER (Symbol IS NULL) + count(*) FILTER (Name IS NULL) AS violations, false AS valid FROM raw_listing UNION ALL SELECT 'bars', count(*) FILTER (Date IS NULL) + count(*) FILTER (Close IS NULL), true FROM bars"),
    "b11_range_profile": (lambda s, d: B.range_profile({"bars": (V.bars(s, d), "Date"), "fx": (V.fx(s, d), "Date")}), "SELECT 'bars' AS table_name, min(Date) AS min_date, max(Date) AS max_date, count(*) AS n FROM bars UNION ALL SELECT 'fx', min(Date), max(Date), count(*) FROM fx"),
    "b12_fact_profile": (lambda s, d: B.fact_profile(_master(s, d), "Company", "ret_long", "up_long", "rank_target"), "SELECT count(*) AS n, count(DISTINCT Company) AS keys, count(ret_long) AS present, round(avg(ret_long), 6) AS mean, round(stddev_samp(ret_long), 6) AS sd, round(avg(up_long), 6) AS label_rate, round(min(rank_target), 6) AS rank_min, round(max(rank_target), 6) AS rank_max FROM master"),
    "c1_trading_calendar": (lambda s, d: I.trading_calendar(V.bars(s, d)), "SELECT DISTINCT Date FROM bars"),
    "c2_fill_rates": (lambda s, d: I.fill_rates(_calendar(s, d), V.fx(s, d), ["EUR", "JPY"]), "SELECT * FROM filled"),
    "c3_default_rate": (lambda s, d: I.default_rate(V.bars(s, d).select("Company", "Date"), V.fx(s, d), "EUR"), "SELECT Company, Date, coalesce(EUR, 0.92) AS EUR FROM bars LEFT JOIN fx USING (Date)"),
    "c4_forward_price": (lambda s, d: _fwd(s, d).select("Company", "Date", "a7", "a14"), "SELECT Company, Date, a7, a14 FROM fwd"),
    "c5_tradeable_filter": (lambda s, d: _fwd(s, d).where(I.tradeable("Close", ["a7", "a14"])).select("Company", "Date", "Close"), "SELECT Company, Date, Close FROM fwd WHERE Close >= 1.0 AND a7 >= 0.5 AND a14 >= 0.5"),
    "c6_forward_return_pct": (lambda s, d: _fwd(s, d).select("Company", "Date", R(I.forward_return_pct("a7", "Close")).alias("ret")), "SELECT Company, Date, round((a7 - Close) / nullif(Close, 0) * 100, 6) AS ret FROM fwd"),
    "c7_clip": (lambda s, d: _fwd(s, d).select("Company", "Date", R(I.clip(I.forward_return_pct("a7", "Close"), -100.0, 200.0)).alias("ret")), "SELECT Company, Date, CASE WHEN a7 IS NOT NULL AND Close <> 0 THEN round(greatest(-100, least((a7 - Close) / nullif(Close, 0) * 100, 200)), 6) END AS ret FROM fwd"),
    "c8_direction_label": (lambda s, d: _fwd(s, d).withColumn("ret", I.forward_return_pct("a7", "Close")).select("Company", "Date", I.direction_label("ret", 0.5).alias("up")), "SELECT Company, Date, CASE WHEN (a7 - Close) / nullif(Close, 0) * 100 > 0.5 THEN 1 ELSE 0 END AS up FROM fwd"),
    "c9_rank_target": (lambda s, d: _fwd(s, d).where("a7 is not null").withColumn("ret", I.forward_return_pct("a7", "Close")).select("Company", "Date", R(I.rank_target("ret")).alias("rank_target")), "SELECT Company, Date, round(percent_rank() OVER (PARTITION BY Date ORDER BY (a7 - Close) / nullif(Close, 0) * 100 NULLS LAST), 6) AS rank_target FROM fwd WHERE a7 IS NOT NULL"),
    "c10_build_master": (lambda s, d: _master(s, d).withColumns({c: R(c) for c in ("close", "EUR", "JPY", "ret_short", "ret_long", "rank_target")}), "SELECT Company, Date, round(close, 6) AS close, volume, round(EUR, 6) AS EUR, round(JPY, 6) AS JPY, Sector, Industry, MarketCap, round(ret_short, 6) AS ret_short, up_short, round(ret_long, 6) AS ret_long, up_long, round(rank_target, 6) AS rank_target FROM master"),
    "c11_company_base": (_c11, "SELECT l.Symbol, coalesce(m.Name, l.Name) AS Name, coalesce(m.Sector, l.Sector) AS Sector, coalesce(m.MarketCap, l.MarketCap) AS MarketCap FROM companies l LEFT JOIN members m ON m.Symbol = l.Symbol WHERE l.Symbol IN (SELECT Symbol FROM acquisitions)"),
    "c12_intraday_volatility": (lambda s, d: I.intraday_volatility(V.bars(s, d)).select("Company", R("volatility").alias("volatility")), "SELECT Company, round(stddev_samp((Close - Open) / nullif(Open, 0)) * 100, 6) AS volatility FROM bars GROUP BY Company"),
    "c13_size_class": (lambda s, d: V.companies(s, d).select("Symbol", I.size_class("MarketCap", (8000, 5000, 2000)).alias("size_class")), "SELECT Symbol, CASE WHEN MarketCap IS NULL THEN 'Unknown_Size' WHEN MarketCap >= 8000 THEN 'Mega_Cap' WHEN MarketCap >= 5000 THEN 'Large_Cap' WHEN MarketCap >= 2000 THEN 'Mid_Cap' ELSE 'Small_Cap' END AS size_class FROM companies"),
    "c14_volatility_class": (lambda s, d: I.intraday_volatility(V.bars(s, d)).select("Company", I.volatility_class("volatility", (900, 1400)).alias("volatility_class")), "SELECT Company, CASE WHEN v IS NULL THEN 'Unknown_Volatility' WHEN v < 900 THEN 'Low_Volatility' WHEN v < 1400 THEN 'Medium_Volatility' ELSE 'High_Volatility' END AS volatility_class FROM (SELECT Company, stddev_samp((Close - Open) / nullif(Open, 0)) * 100 AS v FROM bars GROUP BY Company)"),
    "c15_normalise_name": (lambda s, d: _ranking(s, d).select("company", "publish_year", I.normalise_name("company").alias("name")), f"SELECT company, publish_year, trim({ALIKE.format('company')}) AS name FROM ranking"),
    "c16_latest_per_key": (lambda s, d: I.latest_per_key(_ranking(s, d), "company", "publish_year").where("country is not null"), "SELECT company, rank, publish_year, country FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY publish_year DESC) AS r FROM ranking) WHERE r = 1 AND country IS NOT NULL"),
    "c17_resolve_country": (_c17, C17),
    "c18_publish_lookup": (lambda s, d: _c17(s, d).select("Symbol", F.col("Country").alias("country")), f"SELECT Symbol, Country AS country FROM ({C17})"),
    "c19_border_names": (_c19, "SELECT a.n_name AS country, string_agg(b.n_name, ',' ORDER BY b.n_name) AS borders FROM nation a JOIN nation b ON b.n_nationkey - a.n_nationkey IN (1, 7, 20) GROUP BY a.n_name"),
    "c20_country_attributes": (_c20, "SELECT Symbol, Country, coalesce(r_name, 'Unknown_region') AS region FROM raw_listing LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON n_name = Country"),
    "c21_attach_indicators": (_c21, "SELECT n_name AS iso3, max(CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN c_acctbal END) AS AUTOMOBILE, max(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END) AS BUILDING, max(CASE WHEN c_mktsegment = 'FURNITURE' THEN c_acctbal END) AS FURNITURE, max(CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN c_acctbal END) AS HOUSEHOLD, max(CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal END) AS MACHINERY FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name"),
    "c22_triples_to_wide": (_c22, "SELECT replace(country, '_', '  ') AS country, round(gdp_usd, 0) AS gdp, CASE WHEN length(country) > 8 THEN CAST(length(country) AS DOUBLE) END AS pop FROM macro WHERE gdp_usd IS NOT NULL OR length(country) > 8"),
    "c23_attach_macro": (lambda s, d: I.attach_macro(V.raw_listing(s, d).select("Symbol", "MarketCap"), V.companies(s, d), V.macro(s, d)), "SELECT l.Symbol, l.MarketCap, gdp_usd FROM raw_listing l LEFT JOIN companies c ON c.Symbol = l.Symbol LEFT JOIN macro ON macro.country = c.Country"),
    "c24_pit_macro": (_c24, C24),
    "c25_asof_latest": (_c25, "SELECT Date, (SELECT max_by(EUR, fx.Date) FROM fx WHERE fx.Date <= c.Date) AS EUR FROM (SELECT DISTINCT Date + 4 AS Date FROM bars) c"),
    "c26_asof_with_tolerance": (_c26, "SELECT c.Date, coalesce(max_by(px, i.Date), 0.0) AS px FROM (SELECT DISTINCT Date + CAST(day(Date) % 8 AS INTEGER) AS Date FROM bars) c LEFT JOIN index_series i ON i.Date <= c.Date AND c.Date - i.Date <= 3 GROUP BY c.Date"),
    "c27_yoy_change": (lambda s, d: V.index_series(s, d).select("Date", R(I.yoy_change("px")).alias("yoy")), "SELECT Date, round((px / lag(px, 12) OVER (ORDER BY Date) - 1) * 100, 6) AS yoy FROM index_series"),
    "c28_static_metadata": (_c28, "SELECT Company, max(Sector) AS Sector, max(Industry) AS Industry, max(MarketCap) AS MarketCap, max_by(EUR, Date) AS EUR, max_by(JPY, Date) AS JPY FROM master GROUP BY Company"),
    "c29_fill_defaults": (_c29, "SELECT Symbol, CASE WHEN Symbol % 2 = 0 THEN coalesce(Sector, 'Technology') ELSE 'Technology' END AS Sector, CASE WHEN MarketCap > 0 THEN MarketCap ELSE 5e10 END AS MarketCap FROM companies"),
    "c30_business_days": (_c30, "SELECT CAST(x AS DATE) AS Date FROM (SELECT unnest(generate_series(min(Date)::timestamp, max(Date)::timestamp, INTERVAL 1 DAY)) AS x FROM bars) WHERE isodow(x) < 6"),
}
MORE = {"ranking": RANKING, "filled": FILLED, "master": MASTER, "members": MEMBERS, "fwd": FWD}
ORACLES = {k: oracle(sql, **MORE) for k, (_, sql) in QUERIES.items() if sql}
