"""Sources, sinks, streams, and models on small inputs."""

import datetime
import itertools
import json
import math
import random

from pyspark.sql import functions as F

from barloom.functions import features as X
from barloom.operators import graph as G
from barloom.operators import portfolio as H
from barloom.operators import quality as B
from barloom.operators import series as S
from barloom.sources import tables as A
from barloom.sources.versioned import VersionedTable
from barloom.streaming import streams


def test_csv_table_and_log(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Symbol,Cap\nA,1.5\nB,\n")
    df = A.scan_csv(spark, str(tmp_path / "a.csv"), "Symbol string, Cap double")
    A.write_table(df, str(tmp_path / "t"))
    A.write_table(df.limit(1), str(tmp_path / "u"))
    A.append_log(df, str(tmp_path / "log"))
    A.append_log(df, str(tmp_path / "log"))
    A.write_results(df, str(tmp_path / "r"), "csv")
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 2
    assert A.check_inputs({"a": df, "b": None, "c": df.where("false")}) == {"b": "missing", "c": "empty"}
    row = A.metrics_row(B.quality_metrics(df, {"cap": F.col("Cap") > 1}), "listing").first()
    assert json.loads(row["metric_value"]) == {"raw": 2, "clean": 1, "removed": 1, "removal_rate": "50.00%"}
    assert "Cap" in B.rules_text({"cap": F.col("Cap") > 1})["cap"]
    assert B.quality_metrics(df.where("false"), {"cap": F.col("Cap") > 1}).first()["removal_rate"] == "0%"


def test_triples_on_disk(spark, tmp_path):
    rows = [("ex:a", "ex:p", 'x "y"\\z', "literal", None), ("ex:a", "ex:q", "ex:b", "iri", None), ("ex:a", "ex:r", "1", "literal", "xsd:integer")]
    df = spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_type string")
    A.write_triples(df, str(tmp_path / "g"))
    assert sorted(map(tuple, A.read_triples(spark, str(tmp_path / "g")).collect()), key=str) == sorted(rows, key=str)
    (tmp_path / "i.json").write_text('[{"page": 1}, [{"countryiso3code": "DEU", "value": 2.5}, {"countryiso3code": "FRA", "value": null}]]')
    assert [tuple(r) for r in A.read_indicator_json(spark, str(tmp_path / "i.json")).collect()] == [("DEU", 2.5)]


GOOD = {
    '<ex:a> <ex:p> "x"@en .': ("ex:a", "ex:p", "x", "literal", "@en"),
    '_:b0 <ex:p> _:b1.x .': ("_:b0", "ex:p", "_:b1.x", "blank", None),
    '  <ex:a>\t<ex:p>   <ex:b>  .  # said "so" .': ("ex:a", "ex:p", "ex:b", "iri", None),
    '<ex:a> <ex:p> "caf\\u00E9 \\U0001F600 \\t\\b\\f\\\'"^^<xsd:string>.': ("ex:a", "ex:p", "caf\u00e9 \U0001f600 \t\b\f'", "literal", "xsd:string"),
    '<ex:a><ex:p>"a # b" .': ("ex:a", "ex:p", "a # b", "literal", None),
    '<ex:a> <ex:p> "q" . # then "more" .': ("ex:a", "ex:p", "q", "literal", None),
    '<ex:a> <ex:p> "" .': ("ex:a", "ex:p", "", "literal", None),
    '<ex:a> <ex:p> "x"@de-CH-1996 .': ("ex:a", "ex:p", "x", "literal", "@de-CH-1996"),
    '<ex:caf\\u00e9\\u0020x> <ex:p> <ex:b> .': ("ex:caf\u00e9 x", "ex:p", "ex:b", "iri", None),
    '<ex:a> <ex:p> "' + 'a\\"\\\\u0041' * 50_000 + '" .': ("ex:a", "ex:p", 'a"\\u0041' * 50_000, "literal", None),
}
BAD = {
    "ex:a <ex:p> <ex:b> .": "subject", '"a" <ex:p> <ex:b> .': "subject", "<ex:a> _:p <ex:b> .": "predicate", "<ex:a b> <ex:p> <ex:b> .": "subject", "<ex:a> <ex:p> <ex:b>": "object or end",
    '<ex:a> <ex:p> "a"b" .': "object or end", '<ex:a> <ex:p> "\\x" .': "object or end", '<ex:a> <ex:p> "\\uD83D" .': "object or end", '<ex:a> <ex:p> "\\U00110000" .': "object or end", '<ex:a> <ex:p> "x"@ .': "object or end",
}


def test_ntriples_of_others(spark):
    lines = spark.createDataFrame([(x,) for x in [*GOOD, *BAD, "", "  # a comment", "\t"]], "value string")
    assert sorted(map(tuple, A.parse_triples(lines).collect()), key=str) == sorted(GOOD.values(), key=str)
    assert {r["value"]: r["stops"] for r in A.rejected_lines(lines).collect()} == BAD
    again = A.parse_triples(A.triple_lines(spark.createDataFrame(list(GOOD.values()), "s string, p string, o string, o_kind string, o_type string")))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(GOOD.values(), key=str)


def test_relation_mean_of_a_small_graph(spark):
    edges = spark.createDataFrame([(0, 0, 1), (2, 0, 1), (1, 1, 3)], "h long, r int, t long")
    vectors = spark.createDataFrame([(i, [float((i + 1) * (i == j)) for j in range(4)]) for i in range(4)], "id long, v array<double>")
    got = {(r["node"], r["dim"]): r["value"] for r in G.relation_mean(edges, vectors).collect() if r["value"]}
    assert got == {(1, 0): 0.5, (1, 2): 1.5, (3, 1): 2.0}


def test_upsert_stream(spark, tmp_path):
    schema = "Company long, Date date, Close double, load int"
    day = lambda n: datetime.date(2024, 1, n)
    for i, rows in enumerate([[(1, day(1), 1.0, 1), (1, day(2), 2.0, 1)], [(1, day(2), 9.0, 2), (1, day(3), 3.0, 2), (2, day(1), 4.0, 2)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streams.upsert_stream(source, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r)[:3] for r in VersionedTable(spark, str(tmp_path / "out"), source.schema).read().collect())
    assert got == [(1, day(1), 1.0), (1, day(2), 2.0), (1, day(3), 3.0), (2, day(1), 4.0)]


def test_loss_falls_and_hmm_finds_two_variances(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.01, 150), rng.normal(0, 0.1, 100)])
    fitted = S.baum_welch(x)
    assert abs(fitted["var"][0] ** 0.5 - 0.01) < 0.003 and abs(fitted["var"][1] ** 0.5 - 0.1) < 0.02 and fitted["last"][1] > 0.9
    y = 100 + np.cumsum(np.ones(60))
    beta, aic = S._css(y, 0, 1, 0)
    assert abs(beta[0] - 1) < 1e-9 and np.allclose(S._forecast(y, (0, 1, 0), beta, 3), y[-1] + np.arange(1, 4))


def test_regimes_of_short_and_gappy_windows():
    import numpy as np

    short = S.baum_welch(np.array([0.1, np.nan] * 9))
    assert short == {"mean": [0.0, 0.0], "var": [1e-4, 4e-4], "stay": [0.9, 0.9], "last": [0.5, 0.5], "loglik": 0.0}
    x = np.concatenate([np.random.default_rng(1).normal(0, 0.01, 60), [np.nan]])
    assert S.baum_welch(x) == S.baum_welch(x[:-1])


def test_asof_windows_against_plain_code(spark):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(days=n)
    rows = [(k, day(i * step), float(i)) for k, step in (("a", 1), ("b", 3)) for i in range(40)]
    asof = [day(n) for n in (-1, 0, 5, 17, 39, 200)]
    got = S.asof_windows(spark.createDataFrame(rows, "series string, Date date, value double"), spark.createDataFrame([(x,) for x in asof], "asof date"), 7)
    want = {(k, x): [v for s, d, v in rows if s == k and d <= x][-7:] for k in "ab" for x in asof}
    assert {(r["series"], r["asof"]): list(r["values"]) for r in got.collect()} == {k: v for k, v in want.items() if v}


def test_synthetic_rows_lie_between_near_neighbours(spark):
    import numpy as np

    from barloom.operators import evaluate as E

    rng = np.random.default_rng(3)
    small = np.round(np.concatenate([rng.normal(0, 1, (60, 3)), rng.normal(50, 1, (60, 3))]), 6)
    rows = [(1, x.tolist()) for x in np.concatenate([small, small[:30]])] + [(0, [float(i), 0.0, 0.0]) for i in range(1000)]
    out = E.oversample_minority(spark.createDataFrame(rows, "label int, features array<double>"), "label", cell_rows=40)
    got = [r["features"] for r in out.where("label = 1").collect()]
    assert len(got) == 1000 == out.where("label = 0").count()
    given = {tuple(x) for x in small.tolist()}
    made = np.array([x for x in got if tuple(x) not in given])
    assert len(made) > 700
    near = np.sort(np.linalg.norm(small[:, None] - small[None], axis=2), axis=1)[:, 40].max()
    for x in made:
        a = small[:, None] - x
        to = np.linalg.norm(small - x, axis=1)
        i, j = np.triu_indices(len(small), 1)
        slack = to[i] + to[j] - np.linalg.norm(small[i] - small[j], axis=1)
        best = slack.argmin()
        assert slack[best] < 1e-4 and np.linalg.norm(small[i[best]] - small[j[best]]) <= near and a is not None


def test_each_two_blocks_meet_once(spark):
    for blocks in (2, 4, 6, 10):
        met = set()
        for turn in range(blocks - 1):
            mates = {r["id"]: r["m"] for r in spark.range(blocks).select("id", G.partner(F.col("id"), turn, blocks).alias("m")).collect()}
            assert all(mates[m] == b and m != b for b, m in mates.items())
            met |= {frozenset(x) for x in mates.items()}
        assert len(met) == blocks * (blocks - 1) // 2


def test_training_by_blocks_is_no_worse(spark):
    """A graph in which each relation moves along a ring: trained by pairs of blocks, its loss and hits are about those of one task."""
    edges = spark.range(160).selectExpr("id % 40 as h", "cast(id div 40 as int) % 2 as r", "(id % 40 + 1 + (id div 40) % 2 * 2) % 40 as t").distinct()
    vectors = spark.range(41).selectExpr("id", "transform(sequence(0, 7), i -> sin(id * 3.1 + i)) as re", "transform(sequence(0, 7), i -> cos(id * 1.7 + i * 2)) as im")  # the last has no edge
    phases = spark.range(2).selectExpr("cast(id as int) as r", "transform(sequence(0, 7), i -> double(i + id)) as phase")
    told = {}
    for task_edges in (50_000, 20):
        ent, rel, losses = G.train_rotate(edges, vectors, phases, epochs=120, rate=0.05, sync=20, patience=1000, task_edges=task_edges)
        assert len(losses) == 120 and losses[-1] < 0.6 * losses[0] and ent.count() == 41 and rel.count() == 2
        assert all(len(r["re"]) == 8 and len(r["im"]) == 8 for r in ent.collect()) and all(len(r["phase"]) == 8 for r in rel.collect())
        every = edges.select("h", "r").distinct().join(vectors.select(F.col("id").alias("t")))
        scored = G.rotated(every, ent, rel).withColumn("d", G.distance())
        top = {(r["h"], r["r"]): r["best"] for r in scored.groupBy("h", "r").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "t"))), 1, 5).alias("best")).collect()}
        wrong = G.negative_samples(edges, 41)
        lost = G.rotate_loss(G.rotated(edges, ent, rel).withColumn("d", G.distance()), G.rotated(wrong, ent, rel).withColumn("d", G.distance())).first()["loss"]
        told[task_edges] = lost, sum(r["t"] in [b["t"] for b in top[r["h"], r["r"]]] for r in edges.collect()) / edges.count()
    assert told[20][0] <= told[50_000][0] * 1.1 + 0.02 and told[20][1] >= told[50_000][1] - 0.1, told


def test_breaker_stream(spark, tmp_path):
    conf = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        day = lambda n: datetime.date(2024, 1, n)
        schema = "account long, Date date, equity double"
        for rows in ([(1, day(1), 100.0), (1, day(2), 110.0), (2, day(1), 50.0)], [(1, day(3), 104.0), (1, day(4), 120.0), (2, day(2), 49.0)]):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            query = streams.breaker_stream(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            query.awaitTermination()
        got = sorted((r["account"], r["Date"].day, r["peak"], r["halted"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        assert got == [(1, 1, 100.0, False), (1, 2, 110.0, False), (1, 3, 110.0, True), (1, 4, 120.0, True), (2, 1, 50.0, False), (2, 2, 50.0, False)]
    finally:
        spark.conf.unset(conf)


def _day(i):
    return datetime.date(2020, 1, 1) + datetime.timedelta(days=i)


def test_means_along_series_with_gaps(spark):
    draw = random.Random(5)
    prices = {c: [None if draw.random() < 0.1 else round(draw.uniform(5, 50), 2) for _ in range(60)] for c in "ab"}
    prices["one"], prices["none"] = [3.0], [None, None]
    df = spark.createDataFrame([(c, _day(i), x) for c, xs in prices.items() for i, x in enumerate(xs)], "Company string, Date date, px double")
    rsi = {(r["Company"], r["Date"]): r["rsi"] for r in X.rsi(df, "px", 14).collect()}
    macd = {(r["Company"], r["Date"]): (r["macd"], r["macd_signal"]) for r in X.macd(df, "px").collect()}
    assert len(rsi) == len(macd) == 123
    for c, xs in prices.items():
        known, moves = [], []
        fast = slow = signal = None
        for i, x in enumerate(xs):
            if i and x is not None and xs[i - 1] is not None:
                moves.append(x - xs[i - 1])
            want = 50.0
            if len(moves) >= 14:
                weights = [(13 / 14) ** (len(moves) - 1 - j) for j in range(len(moves))]
                gain, loss = (sum(w * max(s * m, 0) for w, m in zip(weights, moves)) / sum(weights) for s in (1, -1))
                want = 100 - 100 / (1 + gain / (loss or 1e-9))
            assert math.isclose(rsi[c, _day(i)], want, rel_tol=1e-9)
            if x is not None:
                known.append(x)
                fast = x if fast is None else fast * 11 / 13 + x * 2 / 13
                slow = x if slow is None else slow * 25 / 27 + x * 2 / 27
            if fast is not None:
                signal = fast - slow if signal is None else signal * 0.8 + (fast - slow) * 0.2
            got = macd[c, _day(i)]
            assert math.isclose(got[0], fast - slow if known else 0.0, abs_tol=1e-9) and math.isclose(got[1], signal if known else 0.0, abs_tol=1e-9)
    assert X.rsi(df.where("false"), "px").count() == X.macd(df.where("false"), "px").count() == 0


def test_viterbi_against_all_paths(spark):
    draw = random.Random(6)
    mean, var, stay = [0.0, 0.4], [1.0, 3.0], [0.9, 0.7]
    values = {f"s{n}": [None if draw.random() < 0.15 else draw.gauss(0, 2) for _ in range(n)] for n in (1, 2, 7, 9)}
    df = spark.createDataFrame([(s, _day(i), x) for s, xs in values.items() for i, x in enumerate(xs)], "series string, Date date, value double")
    found = {}
    for r in S.viterbi(df, mean, var, stay).orderBy("series", "Date").collect():
        found.setdefault(r["series"], []).append(r["state"])

    def score(path, xs):
        total = math.log(0.5)
        for i, (s, x) in enumerate(zip(path, xs)):
            total += 0 if x is None else -0.5 * (math.log(2 * math.pi * var[s]) + (x - mean[s]) ** 2 / var[s])
            total += 0 if i == 0 else math.log(stay[s] if path[i - 1] == s else 1 - stay[path[i - 1]])
        return total

    for s, xs in values.items():
        best = max(score(p, xs) for p in itertools.product((0, 1), repeat=len(xs)))
        assert len(found[s]) == len(xs) and math.isclose(score(found[s], xs), best, rel_tol=1e-9)


def test_equity_with_impact_against_a_loop(spark):
    draw = random.Random(7)
    names, days = "abcde", [0, 7, 14, 21, 28]
    rows = [(k, _day(i), c, draw.uniform(-0.5, 0.6), draw.choice([None, draw.uniform(-0.2, 0.2)]), draw.choice([None, 0.03, 2.0]), draw.choice([None, 0.0, 1e5])) for k in ("x", "y") for i in days for c in names if draw.random() < 0.7]
    df = spark.createDataFrame(rows, "strategy string, Date date, Company string, weight double, ret double, vol double, adv double")
    got = {(r["strategy"], r["Date"]): r["equity"] for r in H.equity_with_impact(df, ["strategy"], cash=1e6).collect()}
    want = {}
    for k in ("x", "y"):
        equity, held = 1e6, {}
        periods = sorted({r[1] for r in rows if r[0] == k})
        for day in [*periods, None]:
            now = {r[2]: (r[3], r[4] or 0.0, 0.02 if r[5] is None else r[5], 1e7 if r[6] is None else r[6]) for r in rows if r[0] == k and r[1] == day}
            cost = 0.0
            for c in {*now, *held}:
                move = abs((now[c][0] if c in now else 0) - (held[c][0] if c in held else 0))
                _, _, vol, adv = now.get(c) or held[c]
                size = move * equity
                cost += size * min(0.0005 + 0.5 * vol * math.sqrt(size / max(adv, 1.0)), 0.02) if move >= 1e-6 else 0
            gain = sum(w * r for w, r, _, _ in now.values())
            equity = (equity - cost) * (1 + gain)
            held = {c: (w * (1 + r) / (1 + gain), r, v, a) for c, (w, r, v, a) in now.items()}
            want[k, day or periods[-1]] = equity
    assert got.keys() == want.keys() and all(math.isclose(got[x], want[x], rel_tol=1e-9) for x in want)
    assert H.equity_with_impact(df.where("false"), ["strategy"]).count() == 0
