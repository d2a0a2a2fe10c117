"""Graph patterns against nested loops over the triples, the order of joins, and proofs of what SQL does not show."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import graph as G
from barloom.operators import patterns as P
from barloom.operators import series as S
from barloom.sources.scratch import written

COLUMNS = "s string, p string, o string, o_kind string, o_type string"


def made(seed):
    draw = random.Random(seed)
    node = lambda: f"ex:n{draw.randrange(12)}"
    rows = {(node(), f"ex:p{draw.randrange(3)}", node(), "iri", None) for _ in range(60)}
    rows |= {(node(), "ex:label", draw.choice(["n1", "ex:n1", "2"]), "literal", draw.choice([None, "xsd:string", "@en"])) for _ in range(15)}
    return sorted(rows, key=str)


def loops(rows, patterns):
    """Sets of {variable: (term, whether a literal, type)}."""
    end = lambda r, i: (r[i], i == 2 and r[3] == "literal", r[4] if i == 2 and r[3] == "literal" else None)
    found = [{}]
    for s, p, o in patterns:
        after = []
        for b in found:
            for r in rows:
                if r[1] != f"ex:{p}":
                    continue
                new = dict(b)
                for i, t in ((0, s), (2, o)):
                    if t.startswith("?"):
                        if new.setdefault(t[1:], end(r, i)) != end(r, i):
                            break
                    elif end(r, i) != (t, False, None):
                        break
                else:
                    after.append(new)
        found = after
    return sorted(tuple(sorted((k, v[0]) for k, v in b.items())) for b in found)


@pytest.mark.parametrize("seed", range(3))
def test_patterns_against_loops(spark, seed):
    rows = made(seed)
    graph = P.PatternGraph(written(P.encoded(spark.createDataFrame(rows, COLUMNS)), "p"))
    for patterns in (
        [("?a", "p0", "?b")], [("?a", "p0", "?b"), ("?b", "p1", "?c")], [("?a", "p0", "?b"), ("?b", "p1", "?c"), ("?c", "p2", "?a")], [("?a", "p0", "ex:n3")], [("ex:n1", "p1", "?x"), ("?x", "label", "?l")],
        [("?a", "p0", "?a")], [("?a", "label", "?l"), ("?b", "label", "?l")], [("?a", "none", "?b")], [("?a", "p2", "?l"), ("?b", "label", "?l")],
    ):
        got = graph.match(*patterns)
        names = sorted(c for c in got.columns if not c.endswith("_term"))
        assert sorted(tuple((n, r[f"{n}_term"]) for n in names) for r in got.collect()) == loops(rows, patterns)
    have = {r[0] for r in rows if r[1] == "ex:label"}
    base = graph.match(("?a", "p0", "?b"))
    assert graph.not_exists(base, ("?a", "label", "?l")).count() == sum(r[1] == "ex:p0" and r[0] not in have for r in rows)
    assert graph.optional(base, ("?a", "label", "?l")).where("l is null").count() == sum(r[1] == "ex:p0" and r[0] not in have for r in rows)
    assert sorted(map(tuple, graph.triples().select("s", "p", "o", "o_kind", "o_type").collect()), key=str) == rows


def test_order_of_joins(spark):
    rows = [("ex:a", "ex:one", "ex:b", "iri", None)] + [(f"ex:a{i % 7}", "ex:some", f"ex:b{i}", "iri", None) for i in range(50)] + [(f"ex:b{i % 50}", "ex:many", f"ex:c{i}", "iri", None) for i in range(900)]
    graph = P.PatternGraph(P.encoded(spark.createDataFrame(rows, COLUMNS)))
    asked = [("?y", "many", "?z"), ("?x", "some", "?y"), ("?w", "one", "?x")]
    for written_as in itertools.permutations(asked):
        assert [p for _, p, _ in graph.order(list(written_as))] == ["one", "some", "many"]
    assert [p for _, p, _ in graph.order([("?y", "many", "?z"), ("?x", "some", "?y")])] == ["some", "many"]
    assert graph.rows(("ex:a1", "some", "?y")) < graph.rows(("?x", "some", "?y"))
    with pytest.raises(ValueError, match="shares no variable"):
        graph.order([("?a", "one", "?b"), ("?c", "some", "?d")])


def test_shared_numbers_are_an_error(spark):
    edges = P.encoded(spark.createDataFrame([("ex:a", "ex:p", "ex:b", "iri", None)], COLUMNS))
    assert P.shared_numbers(edges).isEmpty()
    with pytest.raises(ValueError, match="another seed"):
        P.PatternGraph(edges.unionByName(edges.withColumn("s_term", F.lit("ex:other"))))


def test_pca_is_the_decomposition(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (300, 6)) @ rng.normal(0, 1, (6, 6)) + 5
    out, shares = G.pca(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), 4)
    got = np.array([r["projection"] for r in out.orderBy("id").collect()])
    centred = x - x.mean(axis=0)
    values = np.linalg.svd(centred, compute_uv=False) ** 2
    cov = got.T @ got
    assert np.allclose(np.diag(cov), values[:4]) and np.allclose(cov, np.diag(np.diag(cov)), atol=1e-6 * values[0])
    assert np.allclose(shares, values[:4] / values.sum()) and sorted(shares, reverse=True) == shares
    basis = np.linalg.lstsq(got, centred, rcond=None)[0]
    assert np.isclose(((centred - got @ basis) ** 2).sum(), values[4:].sum())


def test_arima_orders_against_closed_forms_and_known_coefficients():
    rng = np.random.default_rng(1)
    y = np.cumsum(rng.normal(0.3, 1, 400))
    for d in (0, 1, 2):
        beta, aic = S._css(y, 0, d, 0)
        z = np.diff(y, d)
        assert np.isclose(beta[0], z.mean(), atol=1e-4) and np.isfinite(aic)
    assert np.allclose(S._forecast(y, (0, 1, 0), S._css(y, 0, 1, 0)[0], 5), y[-1] + np.arange(1, 6) * np.diff(y).mean(), atol=1e-2)
    noise, x = rng.normal(0, 1, 3000), np.zeros(3000)
    for i in range(1, 3000):
        x[i] = 0.7 * x[i - 1] + noise[i]
    beta, _ = S._css(x, 1, 0, 0)
    assert abs(beta[1] - 0.7) < 0.05
    assert S._css(x, 1, 0, 0)[1] < S._css(x, 0, 0, 0)[1]


def test_looking_for_shared_numbers_moves_no_text(spark):
    rows = [("ex:a", "ex:p", "ex:b", "iri", None), ("ex:b", "ex:q", "1.0", "literal", "xsd:float"), ("ex:a", "ex:q", "1.0", "literal", "xsd:integer")]
    edges = P.encoded(spark.createDataFrame(rows, COLUMNS))
    assert P.look_through(edges) is edges
    with pytest.raises(ValueError, match="share a number"):
        P.look_through(edges.withColumn("s", F.lit(7)))
    with pytest.raises(ValueError, match="share a number"):
        P.look_through(edges.withColumn("o", F.lit(7)))


def test_triples_are_made_without_an_interpreted_filter(spark):
    df = spark.createDataFrame([("a", None), ("b", "x"), (None, "y")], "s string, o string")
    made = G.triples(df, G.iri(F.col("s"), "p", F.col("o")), G.literal(F.col("s"), "q", F.col("o")))
    assert sorted(tuple(r)[:3] for r in made.collect()) == [("b", "ex:p", "x"), ("b", "ex:q", "x")]
    assert "lambda" not in made._jdf.queryExecution().toString()
