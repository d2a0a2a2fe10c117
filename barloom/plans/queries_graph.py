"""Queries of the knowledge graph (e), each with its SQL: the graph side joins triples, the SQL side the tables behind them."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import graph as G
from barloom.operators import integrate as I
from barloom.operators import patterns as P
from barloom.plans import views as V
from barloom.plans.queries_base import FILLED
from barloom.plans.views import oracle
from barloom.sources.scratch import Stored

R = lambda c, n=6: F.round(c, n)


#: Graphs as tables by predicate, and bars with the price that follows, written once for a version of their input.
STORED = Stored()


def _weekly(s, d):
    """Bars with a7, the close seven bars on: a company's lines move once, for its bars and what comes after them."""
    lines = V.table(s, d, "lineitem")
    return STORED.get("weekly", d, lines, lambda: V.bars(s, d, together=True).withColumn("a7", I.forward_price(7)).select("Company", "Date", "Open", "Close", "Volume", "a7"))


def _base(s, d, bars=None):
    vol = I.intraday_volatility(V.bars(s, d) if bars is None else bars).withColumnRenamed("Company", "Symbol")
    listed = V.companies(s, d).join(vol, "Symbol", "left")
    return listed.withColumns({"size_class": I.size_class("MarketCap", (8000, 5000, 2000)), "volatility_class": I.volatility_class("volatility", (900, 1400))})


BASE = """SELECT c.*, CASE WHEN MarketCap >= 8000 THEN 'Mega_Cap' WHEN MarketCap >= 5000 THEN 'Large_Cap' WHEN MarketCap >= 2000 THEN 'Mid_Cap' ELSE 'Small_Cap' END AS size_class,
 CASE WHEN v IS NULL THEN 'Unknown_Volatility' WHEN v < 900 THEN 'Low_Volatility' WHEN v < 1400 THEN 'Medium_Volatility' ELSE 'High_Volatility' END AS volatility_class
 FROM companies c LEFT JOIN (SELECT Company, stddev_samp((Close - Open) / nullif(Open, 0)) * 100 AS v FROM bars GROUP BY Company) x ON x.Company = c.Symbol"""


def _obs(s, d, weekly=None):
    rates = I.fill_rates(V.calendar(s, d), V.fx(s, d), ["EUR"])
    weekly = V.bars(s, d, together=True).withColumn("a7", I.forward_price(7)) if weekly is None else weekly
    rows = weekly.where("a7 is not null").withColumn("ret", I.forward_return_pct("a7", "Close"))
    return rows.join(F.broadcast(rates), "Date").select("Company", "Date", "Close", "Volume", I.direction_label("ret", 0.5).alias("up"), "EUR")


OBS = """SELECT Company, Date, Close, Volume, CASE WHEN (a7 - Close) / nullif(Close, 0) * 100 > 0.5 THEN 1 ELSE 0 END AS up, EUR FROM
 (SELECT *, lead(Close, 7) OVER (PARTITION BY Company ORDER BY Date) AS a7 FROM bars) JOIN (SELECT Date, EUR FROM filled) f USING (Date) WHERE a7 IS NOT NULL"""


def _once(name, d, inputs, graph):
    """The graph that graph() gives of what `inputs` reads."""
    return P.PatternGraph(STORED.get(name, d, inputs, lambda: P.look_through(P.encoded(graph())), "p"), checked=True)


def _kg_triples(s, d, bars=None):
    return G.company_triples(_base(s, d, bars)).unionByName(G.macro_triples(V.macro(s, d), V.borders(s, d), V.tensions(s, d))).unionByName(G.acquisition_triples(V.acquisitions(s, d)))


def _kg(s, d):
    rows = _kg_triples(s, d)
    return _once("companies", d, rows, lambda: rows)


def _obs_kg(s, d):
    def graph():
        weekly = _weekly(s, d)
        companies = STORED.get("company triples", d, weekly, lambda: _kg_triples(s, d, weekly))
        return companies.unionByName(G.observation_triples(_obs(s, d, weekly)))

    return _once("companies and observations", d, _kg_triples(s, d).unionByName(G.observation_triples(_obs(s, d))), graph)


COMPANY = """SELECT 'ex:company/' || Symbol AS s, 'ex:type' AS p, 'ex:Company' AS o FROM base UNION SELECT 'ex:company/' || Symbol, 'ex:belongsToSector', 'ex:sector/' || Sector FROM base WHERE Sector IS NOT NULL
 UNION SELECT 'ex:company/' || Symbol, 'ex:inIndustry', 'ex:industry/' || url_encode(Industry) FROM base WHERE Industry IS NOT NULL UNION SELECT 'ex:company/' || Symbol, 'ex:hasSize', 'ex:size/' || size_class FROM base
 UNION SELECT 'ex:company/' || Symbol, 'ex:hasVolatility', 'ex:volatility/' || volatility_class FROM base WHERE volatility_class <> 'Unknown_Volatility'
 UNION SELECT 'ex:company/' || Symbol, 'ex:headquarteredIn', 'ex:country/' || Country FROM base UNION SELECT 'ex:country/' || Country, 'ex:inRegion', 'ex:region/' || url_encode(replace(Region, ' ', '_')) FROM base"""


def _name(c, prefix):
    return G.str_after(f"{c}_term", prefix).alias(c)


def _term(*names):
    """In a group of a variable's number, its term."""
    return [F.any_value(f"{c}_term").alias(f"{c}_term") for c in names]


def _e3(s, d):
    """Numbers are told apart by their value, not by how either engine prints it."""
    rows, literal = G.observation_triples(_obs(s, d)), F.col("o_kind") == "literal"
    return rows.select("s", "p", F.when(~literal, F.col("o")).alias("node"), F.when(literal, F.col("o").try_cast("double")).alias("number"))


E3 = """SELECT 'ex:company/' || Company AS s, 'ex:hasObservation' AS p, 'ex:obs/' || Company || '_' || Date AS node, NULL::double AS number FROM obs UNION ALL SELECT 'ex:obs/' || Company || '_' || Date, 'ex:recordedOn', 'ex:date/' || Date, NULL FROM obs
 UNION ALL SELECT 'ex:obs/' || Company || '_' || Date, 'ex:closePrice', NULL, Close FROM obs UNION ALL SELECT 'ex:obs/' || Company || '_' || Date, 'ex:tradeVolume', NULL, Volume FROM obs
 UNION ALL SELECT 'ex:obs/' || Company || '_' || Date, 'ex:target7dUp', NULL, up FROM obs UNION ALL SELECT 'ex:date/' || Date, 'ex:eurExchangeRate', NULL, EUR FROM (SELECT DISTINCT Date, EUR FROM obs)"""


def _e4(s, d):
    """Prices are told apart by their value, not by how either engine prints it."""
    rows = G.acquisition_triples(V.acquisitions(s, d))
    node = lambda c: F.regexp_replace(c, "_[^_]*$", "")
    return rows.select(F.when(F.startswith("s", F.lit("ex:acq")), node("s")).otherwise(F.col("s")).alias("s"), "p", F.when(F.col("o_kind") == "iri", node("o")).otherwise(R(F.col("o").cast("double"), 2).cast("decimal(20,2)").cast("string")).alias("o"))


_NODE = "'ex:acquisition/' || Symbol || '_' || acquired || '_' || yr"
E4 = f"SELECT 'ex:company/' || Symbol AS s, 'ex:acquired' AS p, {_NODE} AS o FROM acq UNION ALL SELECT {_NODE}, 'ex:acquisitionYear', CAST(CAST(yr AS DECIMAL(20, 2)) AS VARCHAR) FROM acq UNION ALL SELECT {_NODE}, 'ex:acquisitionPrice', CAST(CAST(round(price, 2) AS DECIMAL(20, 2)) AS VARCHAR) FROM acq WHERE price IS NOT NULL"


def _e10(s, d):
    rows = _obs_kg(s, d).match(("?c", "belongsToSector", "?sector"), ("?c", "hasSize", "?size"), ("?c", "hasObservation", "?ob"), ("?ob", "target7dUp", "?up"))
    out = rows.groupBy("sector", "size").agg(*_term("sector", "size"), R(F.avg(F.col("up_term").cast("double"))).alias("mean_up"), F.count("*").alias("n")).where("n >= 100")
    return out.select(_name("sector", "sector/"), _name("size", "size/"), "mean_up", "n").orderBy(F.desc("mean_up"))


def _e11(s, d):
    kg = _kg(s, d)
    rows = kg.match(("?c", "hasVolatility", f"{G.BASE}volatility/High_Volatility"), ("?c", "headquarteredIn", "?country"), ("?country", "hasTensionWith", "?rival"))
    # the rival's country is named again under another prefix, and found by the rewritten name
    rows = rows.withColumn("rival_term", F.concat(F.lit(f"{G.BASE}country/"), G.str_after("rival_term", "country/"))).withColumn("rival", kg.node(F.col("rival_term")))
    rows = kg.optional(kg.optional(rows, ("?country", "gdpUsd", "?gdp")), ("?rival", "gdpUsd", "?rival_gdp")).distinct()
    rows = rows.select(_name("c", "company/"), _name("country", "country/"), _name("rival", "country/"), R(F.col("gdp_term").cast("double"), 0).alias("gdp"), R(F.col("rival_gdp_term").cast("double"), 0).alias("rival_gdp"))
    return rows.orderBy(F.desc_nulls_last("gdp"), "c", "rival").limit(200)


def _e12(s, d):
    rows = _kg(s, d).match(("?a", "belongsToSector", "?x"), ("?a", "inIndustry", "?y"), ("?a", "hasSize", "?z")).select("x", "y", "z", F.col("a_term").alias("a"))
    # the first 500 pairs of a group are among its first 501 members, whatever its size
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("x", "y", "z").orderBy("a"))).where("n <= 501").drop("n")
    pairs = rows.join(rows.withColumnRenamed("a", "b"), ["x", "y", "z"]).where("a < b")
    return pairs.select(G.str_after("a", "company/").alias("a"), G.str_after("b", "company/").alias("b")).orderBy("a", "b").limit(500)


def _e13(s, d):
    kg = _kg(s, d)
    rows = kg.match(("?c", "hasSize", f"{G.BASE}size/Mega_Cap"), ("?c", "headquarteredIn", "?country"), ("?c", "belongsToSector", "?sector"))
    rows = kg.optional(rows.where(F.col("country_term") == f"{G.BASE}country/NATION_1"), ("?country", "gdpUsd", "?gdp"))
    return rows.groupBy("sector").agg(*_term("sector"), F.countDistinct("c").alias("n"), R(F.max(F.col("gdp_term").cast("double")), 0).alias("gdp")).select(_name("sector", "sector/"), "n", "gdp")


def _e14(s, d):
    kg = _kg(s, d)
    rows = kg.optional(kg.match(("?c", "acquired", "?a")), ("?a", "acquisitionPrice", "?price")).withColumn("price", F.col("price_term").cast("double"))
    return rows.groupBy("c").agg(*_term("c"), F.count("*").alias("n"), F.count("price").alias("priced"), R(F.sum("price"), 2).alias("total"), R(F.avg("price")).alias("mean")).select(_name("c", "company/"), "n", "priced", "total", "mean")


def _e15(s, d):
    rows = _obs_kg(s, d).match(("?c", "hasVolatility", "?v"), ("?c", "hasObservation", "?ob"), ("?ob", "target7dUp", "?up"))
    return rows.groupBy("v").agg(*_term("v"), R(F.avg(F.col("up_term").cast("double"))).alias("mean_up"), F.count("*").alias("n"), F.countDistinct("c").alias("companies")).select(_name("v", "volatility/"), "mean_up", "n", "companies")


def _e16(s, d):
    rows = _kg(s, d).match(("?c", "headquarteredIn", "?x"), ("?x", "sharesBorderWith", "?y"), ("?y", "hasTensionWith", "?z"))
    return rows.select(_name("c", "company/"), _name("x", "country/"), _name("y", "country/"), _name("z", "country/")).distinct().orderBy("c", "y", "z").limit(200)


def _e17(s, d):
    rows = _kg(s, d).match(("?c", "belongsToSector", "?sector"), ("?c", "headquarteredIn", "?x"), ("?x", "inRegion", "?region"))
    return rows.groupBy("sector", "region").agg(*_term("sector", "region"), F.countDistinct("c").alias("n")).select(_name("sector", "sector/"), _name("region", "region/"), "n")


def _e18(s, d):
    kg = _kg(s, d)
    rows = kg.match(("?c", "hasSize", "?size"), ("?c", "belongsToSector", "?sector")).where(F.col("size_term").isin(f"{G.BASE}size/Large_Cap", f"{G.BASE}size/Mega_Cap"))
    high = kg.match(("?v", "hasVolatility", f"{G.BASE}volatility/High_Volatility"), ("?v", "belongsToSector", "?sector")).select("sector")
    kept = kg.not_exists(rows.join(high, "sector", "left_semi"), ("?c", "acquired", "?a"))
    return kept.select(_name("c", "company/"), _name("size", "size/"), _name("sector", "sector/"))


def _e19(s, d):
    rows = _kg(s, d).match(("?c", "belongsToSector", "?sector"), ("?c", "acquired", "?a")).groupBy("sector", "c").agg(*_term("sector", "c"), F.count("*").alias("n"))
    ranked = rows.withColumn("rank", F.rank().over(Window.partitionBy("sector").orderBy(F.desc("n")))).where("rank <= 3")
    return ranked.select(_name("sector", "sector/"), _name("c", "company/"), "n")


ACQ = "SELECT DISTINCT Symbol, acquired, yr, price FROM acquisitions"


def _edges(s, d):
    e = V.table(s, d, "embeddings").select(F.col("vec_id").alias("h"))
    n = e.count()
    return e.withColumn("r", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("t", (F.col("h") * 7 + F.col("r")) % n)


EDGES = "SELECT vec_id AS h, r, (vec_id * 7 + r) % (SELECT count(*) FROM embeddings) AS t FROM embeddings CROSS JOIN (SELECT unnest([0, 1, 2]) AS r)"
DIMS = 32


def _vectors(s, d):
    re, im = G.halves("embedding", DIMS)
    return V.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), re.alias("re"), im.alias("im"), F.col("embedding").alias("v"))


def _phases(s):
    i = F.sequence(F.lit(0), F.lit(DIMS - 1))
    return s.range(3).select(F.col("id").cast("int").alias("r")).withColumn("phase", F.transform(i, lambda x: ((F.col("r") * 31 + x) % 100) / 100.0 * 2 * math.pi - math.pi))


def _distances(s, d, edges):
    return G.rotated(edges, _vectors(s, d).drop("v"), _phases(s)).withColumn("d", G.distance())


SPIN = "(((r * 31 + i - 1) % 100) / 100.0 * 2 * pi() - pi())"
DIST = f"""SELECT e.*, list_sum(list_transform(range(1, 33), lambda i: sqrt(pow(a.embedding[i]::double * cos({SPIN}) - a.embedding[i + 32]::double * sin({SPIN}) - b.embedding[i]::double, 2) + pow(a.embedding[i]::double * sin({SPIN}) + a.embedding[i + 32]::double * cos({SPIN}) - b.embedding[i + 32]::double, 2) + 1e-12))) AS d
 FROM {{}} e JOIN embeddings a ON a.vec_id = e.h JOIN embeddings b ON b.vec_id = e.t"""


def _e21(s, d):
    return G.dictionary_encode(V.companies(s, d).select("Name"), "Name")


def _e25(s, d):
    return G.negative_samples(_edges(s, d), V.table(s, d, "embeddings").count()).select(F.col("edge.h").alias("of_h"), F.col("edge.t").alias("of_t"), "k", "h", "r", "t")


_DRAW = "('0x' || substr(md5(concat_ws(':', h, r, t, k, 0)), {}, 8))::bigint"
E25 = f"""SELECT h AS of_h, t AS of_t, k, CASE WHEN head THEN draw ELSE h END AS h, r, CASE WHEN head THEN t ELSE draw END AS t FROM
 (SELECT *, {_DRAW.format(1)} % (SELECT count(*) FROM embeddings) AS draw, {_DRAW.format(9)} % 2 = 0 AS head FROM edges CROSS JOIN (SELECT unnest(range(1, 9)) AS k))"""


def _e26(s, d):
    edges = _edges(s, d)
    n = V.table(s, d, "embeddings").count()
    neg = edges.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(4)))).select(F.struct("h", "r", "t").alias("edge"), "h", "r", ((F.col("t") + F.col("k") * 11) % n).alias("t"))
    return G.rotate_loss(_distances(s, d, edges), _distances(s, d, neg)).select(R("loss").alias("loss"))


E26 = f"""SELECT round(-(avg(pos) + avg(neg)) / 2, 6) AS loss FROM (SELECT p.h, p.r, p.t, max(-ln(1 + exp(-(6.0 - p.d)))) AS pos, sum(exp(6.0 - n.d) * -ln(1 + exp(6.0 - n.d))) / sum(exp(6.0 - n.d)) AS neg
 FROM distances p JOIN ({DIST.format("(SELECT h, r, t AS t0, (t + k * 11) % (SELECT count(*) FROM embeddings) AS t FROM edges CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k))")}) n ON n.h = p.h AND n.r = p.r AND n.t0 = p.t GROUP BY p.h, p.r, p.t)"""


def _e27(s, d):
    _, _, losses = G.train_rotate(_edges(s, d), _vectors(s, d).drop("v"), _phases(s))
    return s.createDataFrame([(i + 1, float(x)) for i, x in enumerate(losses)], "epoch int, loss double")


def _e29(s, d):
    return G.pca(_vectors(s, d).select("id", "v"), 16)[0].select("id", R(F.aggregate("projection", F.lit(0.0), lambda a, x: a + x * x), 4).alias("energy"))


def _e30(s, d):
    """Orders as observations of customers, of whom only some have a vector."""
    obs = V.table(s, d, "orders").select(F.col("o_custkey").alias("Company"), F.col("o_orderdate").alias("Date"))
    return G.attach_vectors(obs, _vectors(s, d).select(F.col("id").alias("Company"), "v"))[1]


def _e31(s, d):
    out = G.vintage_scale(_vectors(s, d).select("id", F.col("v").cast("array<double>").alias("v")), V.acquisitions(s, d), 1996)
    return out.select("id", R(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"))


STRUCTURE = ["belongsToSector", "inIndustry", "hasSize", "hasVolatility", "headquarteredIn", "inRegion", "sharesBorderWith", "hasTensionWith", "acquired"]
E20 = f"SELECT s, p, o FROM ({COMPANY}) WHERE p <> 'ex:type' UNION SELECT 'ex:country/' || country, 'ex:sharesBorderWith', 'ex:country/' || neighbour FROM borders UNION SELECT 'ex:country/' || country, 'ex:hasTensionWith', 'ex:country/' || rival FROM tensions"


QUERIES = {
    "e1_mint_iri": (lambda s, d: V.companies(s, d).select("Symbol", G.mint_iri("ex:", F.concat("Industry", F.lit(" a/b & c"))).alias("iri")), "SELECT Symbol, 'ex:' || replace(url_encode(replace(Industry || ' a/b & c', ' ', '_')), '%2F', '/') AS iri FROM companies"),
    "e2_company_triples": (lambda s, d: G.company_triples(_base(s, d)).select("s", "p", "o"), COMPANY),
    "e3_observation_triples": (_e3, E3),
    "e4_acquisition_triples": (_e4, E4),
    "e5_macro_triples": (lambda s, d: G.macro_triples(V.macro(s, d), V.borders(s, d), V.tensions(s, d)).select("s", "p", F.when(F.col("o_kind") == "iri", F.col("o")).otherwise(R(F.col("o").try_cast("double"), 0).cast("decimal(20,0)").cast("string")).alias("o")), "SELECT 'ex:country/' || country AS s, 'ex:type' AS p, 'ex:Country' AS o FROM macro UNION ALL SELECT 'ex:country/' || country, 'ex:gdpUsd', CAST(CAST(gdp_usd AS DECIMAL(20, 0)) AS VARCHAR) FROM macro WHERE gdp_usd IS NOT NULL UNION ALL SELECT 'ex:country/' || country, 'ex:sharesBorderWith', 'ex:country/' || neighbour FROM borders UNION ALL SELECT 'ex:country/' || country, 'ex:hasTensionWith', 'ex:country/' || rival FROM tensions"),
    "e6_graph_size": (lambda s, d: G.counts(_once("company", d, G.company_triples(_base(s, d)), lambda: G.company_triples(_base(s, d))).edges), f"SELECT p, count(*) AS n FROM ({COMPANY}) GROUP BY p"),
    "e7_relation_summary": (lambda s, d: G.relation_summary(G.company_triples(_base(s, d))), f"SELECT regexp_replace(p, '^.*[:/#]', '') AS relation, regexp_replace(s, '^.*[:/#]', '') AS s, regexp_replace(o, '^.*[:/#]', '') AS o, n FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY s, o) AS n FROM ({COMPANY})) WHERE n <= 3"),
    "e8_match": (lambda s, d: _kg(s, d).match(("?c", "headquarteredIn", "?x"), ("?x", "gdpUsd", "?gdp"), ("?c", "hasSize", f"{G.BASE}size/Mega_Cap")).select(_name("c", "company/"), _name("x", "country/")), "SELECT CAST(Symbol AS VARCHAR) AS c, b.Country AS x FROM base b JOIN macro m ON m.country = b.Country WHERE gdp_usd IS NOT NULL AND size_class = 'Mega_Cap'"),
    "e9_string_terms": (lambda s, d: V.companies(s, d).select("Symbol", G.str_after("Name", "#").alias("a"), G.str_after("Name", "none").alias("b"), F.concat(F.lit("ex:"), G.str_after("Industry", "Brand")).alias("c")), "SELECT Symbol, split_part(Name, '#', 2) AS a, '' AS b, 'ex:' || replace(Industry, 'Brand', '') AS c FROM companies"),
    "e10_label_by_sector_size": (_e10, "SELECT Sector AS sector, size_class AS size, round(avg(up), 6) AS mean_up, count(*) AS n FROM base JOIN obs ON Company = Symbol GROUP BY ALL HAVING count(*) >= 100"),
    "e11_volatile_in_tension": (_e11, "SELECT DISTINCT CAST(Symbol AS VARCHAR) AS c, b.Country AS country, t.rival, round(m.gdp_usd, 0) AS gdp, round(r.gdp_usd, 0) AS rival_gdp FROM base b JOIN tensions t ON t.country = b.Country LEFT JOIN macro m ON m.country = b.Country LEFT JOIN macro r ON r.country = t.rival WHERE volatility_class = 'High_Volatility' ORDER BY gdp DESC NULLS LAST, c, t.rival LIMIT 200"),
    "e12_peer_pairs": (_e12, "SELECT a, b FROM (SELECT CAST(x.Symbol AS VARCHAR) AS a, CAST(y.Symbol AS VARCHAR) AS b FROM base x JOIN base y ON x.Sector = y.Sector AND x.Industry = y.Industry AND x.size_class = y.size_class) WHERE a < b ORDER BY a, b LIMIT 500"),
    "e13_megacaps_of_country": (_e13, "SELECT Sector AS sector, count(DISTINCT Symbol) AS n, round(max(gdp_usd), 0) AS gdp FROM base b LEFT JOIN macro m ON m.country = b.Country WHERE size_class = 'Mega_Cap' AND b.Country = 'NATION_1' AND Sector IS NOT NULL GROUP BY Sector"),
    "e14_acquisitions_by_company": (_e14, "SELECT CAST(Symbol AS VARCHAR) AS c, count(*) AS n, count(price) AS priced, round(sum(price), 2) AS total, round(avg(price), 6) AS mean FROM acq GROUP BY Symbol"),
    "e15_label_by_volatility": (_e15, "SELECT volatility_class AS v, round(avg(up), 6) AS mean_up, count(*) AS n, count(DISTINCT Symbol) AS companies FROM base JOIN obs ON Company = Symbol WHERE volatility_class <> 'Unknown_Volatility' GROUP BY volatility_class"),
    "e16_two_hops": (_e16, "SELECT DISTINCT CAST(Symbol AS VARCHAR) AS c, x.Country AS x, neighbour AS y, rival AS z FROM base x JOIN borders b ON b.country = x.Country JOIN tensions t ON t.country = b.neighbour ORDER BY c, y, z LIMIT 200"),
    "e17_sector_by_region": (_e17, "SELECT Sector AS sector, url_encode(replace(Region, ' ', '_')) AS region, count(DISTINCT Symbol) AS n FROM base WHERE Sector IS NOT NULL GROUP BY ALL"),
    "e18_no_acquisitions": (_e18, "SELECT CAST(Symbol AS VARCHAR) AS c, size_class AS size, Sector AS sector FROM base WHERE size_class IN ('Large_Cap', 'Mega_Cap') AND Sector IN (SELECT Sector FROM base WHERE volatility_class = 'High_Volatility') AND Symbol NOT IN (SELECT Symbol FROM acq)"),
    "e19_top_acquirers": (_e19, "SELECT sector, c, n FROM (SELECT Sector AS sector, CAST(Symbol AS VARCHAR) AS c, count(*) AS n, rank() OVER (PARTITION BY Sector ORDER BY count(*) DESC) AS k FROM base JOIN acq USING (Symbol) WHERE Sector IS NOT NULL GROUP BY Sector, Symbol) WHERE k <= 3"),
    "e20_structural_edges": (lambda s, d: G.structural_edges(_kg(s, d).triples(), STRUCTURE).where("p <> 'ex:acquired'"), E20),
    "e21_dictionary_encode": (_e21, "SELECT Name, row_number() OVER (ORDER BY Name) - 1 AS id FROM (SELECT DISTINCT Name FROM companies)"),
    "e22_inverse_edges": (lambda s, d: G.with_inverse_edges(_edges(s, d), 3), "SELECT h, r, t FROM edges UNION ALL SELECT t, r + 3, h FROM edges"),
    "e23_relation_mean": (lambda s, d: G.relation_mean(_edges(s, d), _vectors(s, d).select("id", "v")).select("node", "dim", R("value").alias("value")), "SELECT node, dim, round(sum(x), 6) AS value FROM (SELECT t AS node, r, i - 1 AS dim, avg(embedding[i]::double) AS x FROM edges JOIN embeddings ON vec_id = h CROSS JOIN (SELECT unnest(range(1, 65)) AS i) GROUP BY t, r, i) GROUP BY node, dim"),
    "e24_rotate_distance": (lambda s, d: _distances(s, d, _edges(s, d)).select("h", "r", "t", R("d").alias("d")), "SELECT h, r, t, round(d, 6) AS d FROM distances"),
    "e25_negative_samples": (_e25, E25),
    "e26_rotate_loss": (_e26, E26),
    "e27_train_rotate": (_e27, None),
    "e28_company_vectors": (lambda s, d: G.company_vectors(V.companies(s, d).select("Symbol", F.concat(F.lit("ex:"), F.when(F.col("Symbol") % 3 == 0, F.lit("a_b")).otherwise(F.col("Name"))).alias("name"))), "SELECT Symbol, 'ex:' || Name AS name FROM companies WHERE Symbol % 3 <> 0"),
    "e29_pca": (_e29, None),
    "e30_attach_vectors": (_e30, "SELECT count(*) FILTER (o_custkey IN (SELECT vec_id FROM embeddings)) AS kept, count(*) FILTER (o_custkey NOT IN (SELECT vec_id FROM embeddings)) AS dropped FROM orders"),
    "e31_vintage_scale": (_e31, "SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda x: x::double)) * pow(0.92, coalesce(n, 0)), 6) AS total FROM embeddings LEFT JOIN (SELECT Symbol, count(*) AS n FROM acquisitions WHERE yr > 1996 GROUP BY Symbol) ON Symbol = vec_id"),
}
MORE = {"filled": FILLED, "base": BASE, "obs": OBS, "acq": ACQ, "edges": EDGES, "distances": DIST.format("edges")}
ORACLES = {k: oracle(sql, **MORE) for k, (_, sql) in QUERIES.items() if sql}
