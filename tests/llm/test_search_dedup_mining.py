"""Ranked search, exact duplicates and hard negatives against plain code, on odd rows, small blocks and colliding digests."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from barloom.llm import exact_dedup, hard_negatives, queries, ranked_search
from tests.oracle_run import compare, duck

DIRECTORY = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_exact_dedup", "op13_hard_negatives"])
def test_equal_to_sql(spark, name):
    assert compare(spark, duck(DIRECTORY), DIRECTORY, queries.queries()[name], queries.oracle_sql()[name]) == ""


# exact duplicates

ROWS = [(1, "Ab c"), (2, "aB C"), (2, "ab c"), (None, "ab c"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "x" * 1_000_000), (8, "X" * 1_000_000), (None, "alone"), (None, "Alone"), (9, "ab  c")]


def plain_groups(rows):
    groups = collections.defaultdict(list)
    for i, text in rows:
        groups[(text or "").translate(LOW)].append(i)
    return groups


@pytest.mark.parametrize("bits", [0, 2, 63])
def test_dedup_odd_rows(spark, bits):
    docs = spark.createDataFrame([(i, t, 0, "y", 1) for i, t in ROWS], "doc_id long, text string, site int, digest string, row long").repartition(5)
    got = exact_dedup.dedup(docs, digest_bits=bits).collect()
    groups = plain_groups(ROWS)
    assert len(got) == len(ROWS)
    by = {hashlib.sha256(low.encode()).hexdigest(): ids for low, ids in groups.items()}
    for digest, ids in by.items():
        rows = [r for r in got if r["text_sha256"] == digest]
        known = [i for i in ids if i is not None]
        assert sorted((r["doc_id"] or 0) for r in rows) == sorted((i or 0) for i in ids)
        assert {(r["keep_id"], r["group_size"]) for r in rows} == {(max(known) if known else None, len(ids))}
        assert [r["doc_id"] for r in rows if r["kept"]] == [max(known) if known else None]


def test_dedup_smallest_and_empty(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    kept = {r["text_sha256"]: r["doc_id"] for r in exact_dedup.dedup(docs, keep="smallest").where("kept").collect()}
    assert kept == {hashlib.sha256(low.encode()).hexdigest(): min((i for i in ids if i is not None), default=None) for low, ids in plain_groups(ROWS).items()}
    assert exact_dedup.dedup(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.dedup(docs, keep="any")


@pytest.mark.parametrize("partitions, rounds", [(1, 3), (8, 1), (32, 2), (32, 5)])
def test_dedup_tree(spark, partitions, rounds):
    """A third of all rows are one text, over many runs and any number of rounds; a joined key never has a third of them."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)  # entries of a text stand in several batches
    try:
        text = F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 700).cast("string")))
        got = exact_dedup.dedup(spark.range(6000, numPartitions=16).select(F.col("id").alias("doc_id"), text.alias("text")), rounds=rounds).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    groups = plain_groups([(i, "hot" if i % 3 == 0 else f"t{i % 700}") for i in range(6000)])
    want = {i: (max(ids), len(ids), i == max(ids)) for ids in groups.values() for i in ids}
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in got} == want and len(got) == 6000


# ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, k):
    words = [(i, TERM.findall((t or "").translate(LOW))) for i, t in docs]
    words = [(i, collections.Counter(w), len(w)) for i, w in words if w]
    total, count = sum(n for _, _, n in words), len(words)
    df = collections.Counter(t for _, c, _ in words for t in c)
    out = []
    for item, text in items:
        asked = TERM.findall((text or "").translate(LOW))
        scores = []
        for i, c, n in words:
            m = 100 - 25 + (25 * n * count) // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in asked)
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[2] or 0))


def made_documents(n, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "naïve", "A1"]
    docs = [(i, " ".join(rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(len(vocabulary))], k=rng.randint(0, 60)))) for i in range(n)]
    return docs + [(i + n, docs[i % 7][1].upper()) for i in range(60)] + [(None, docs[3][1]), (5, docs[5][1]), (n + 100, None), (n + 101, ""), (n + 102, "... --"), (n + 103, "w1, w2;" * 200_000)]


ITEMS = [(1, "w1 w2 w2 W30"), (2, "été A1 w39"), (3, None), (4, "unknown words"), (5, "w0"), (5, "w5 w6"), (None, "naïve w12"), (7, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w0 w1")]


@pytest.mark.parametrize("cells, chars", [(8_000_000, 2_000_000), (300, 2_000_000), (1, 20)])
def test_search(spark, cells, chars):
    rows = made_documents(400)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, score int, item_id string").repartition(4)
    items = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id long, text string, doc_id int")
    got = [tuple(r) for r in ranked_search.search(docs, items, k=9, cells=cells, item_chars=chars).collect()]
    assert sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[2] or 0)) == plain_search(rows, ITEMS, 9)


def test_search_nothing(spark):
    docs, items = spark.createDataFrame(made_documents(20), "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search.search(docs.limit(0), items).count() == 0
    assert ranked_search.search(docs, items.limit(0)).count() == 0
    assert ranked_search.search(docs.where("text is null"), items).count() == 0


def test_terms_in_windows(monkeypatch):
    monkeypatch.setattr(ranked_search, "WINDOW", 7)
    text = "Abc déf-ghi  jkl;mno9 " * 30
    n, found = ranked_search.term_counts(text.encode())
    want = collections.Counter(TERM.findall(text.translate(LOW)))
    assert n == sum(want.values()) and {k.decode(): v for k, v in found.items()} == want


def test_tree_bounds_hold_and_prune():
    """No document scores over the bounds of the nodes above it, and most of a tree is left out once a list is full."""
    import numpy as np

    rng = random.Random(1)
    profiles = {}
    for i in range(600):
        ranks = sorted(rng.sample(range(30), rng.randint(0, 12)))
        tfs = [rng.randint(1, 5) for _ in ranks]
        profiles.setdefault((np.array(ranks, ">u4").tobytes(), np.array(tfs, "i8").tobytes(), rng.randint(75, 140)), []).append(i)
    tree = ranked_search.Tree(profiles, 30)
    assert any(tree.last)
    for node in range(len(tree.low)):
        span = slice(tree.low[node], tree.high[node])
        assert (tree.tops[node] == tree.tf[span].max(axis=0)).all() and tree.least[node] == tree.m[span].min()
    leaves = [span for span in zip(tree.low, tree.high, tree.last) if not span[2]]
    assert sorted(i for low, high, _ in leaves for i in range(low, high)) == list(range(len(tree.ids)))


# hard negatives


def plain_mining(rows, every=50, n_pos=5, n_neg=3):
    good = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (anchor, va, la) in enumerate(good):
        if anchor is None or anchor % every:
            continue
        scored = sorted((-sum(map(lambda x, y: x * y, va, vb)), i is None, i or 0, lb == la, i) for b, (i, vb, lb) in enumerate(good) if b != a)
        for s, _, _, _, positive in [x for x in scored if x[3]][:n_pos]:
            fits = [x for x in scored if not x[3] and 50 * -s <= 100 * -x[0] <= 95 * -s][:n_neg]
            out += [(anchor, positive, r, x[4], -s, -x[0]) for r, x in enumerate(fits, 1)]
    return sorted(out, key=str)


def made_vectors(n, seed=5):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0.05, 0.2) for _ in range(8)], rng.randint(0, 3)) for i in range(n)]
    nan, inf = float("nan"), float("inf")
    odd = [(1000, None, 1), (1050, [nan] * 8, 1), (1100, [inf] * 8, 2), (1150, [0.5] * 8, None), (1200, [0.1, None], 1), (None, [0.3] * 8, 1), (1250, [0.0] * 8, 0), (1300, [0.2] * 3, 2), (1350, [], 1)]
    return rows + odd + [(0, rows[0][1], rows[0][2]), rows[50], (1001, rows[7][1], rows[7][2]), (1002, rows[7][1], (rows[7][2] + 1) % 4)]


@pytest.mark.parametrize("rows, anchors", [(8192, 4096), (37, 5), (1, 1)])
def test_mining(spark, rows, anchors):
    made = made_vectors(150 if rows > 1 else 55)
    vectors = spark.createDataFrame([(*r, "x", 1) for r in made], "vec_id long, embedding array<double>, label int, anchor_id string, rid int").repartition(3)
    got = sorted((tuple(r) for r in hard_negatives.mine(vectors, every=25 if rows > 1 else 50, rows=rows, anchors=anchors).collect()), key=str)
    want = plain_mining(made, every=25 if rows > 1 else 50)
    assert got == want and want


def test_mining_equal_scores_and_none(spark):
    same = [(i, [1.0, 1.0], i % 2) for i in range(60)]
    made = spark.createDataFrame(same, "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(made).count() == 0  # every score is the same, and so over 95 hundredths
    assert sorted(map(tuple, hard_negatives.mine(made, low=100, high=100).collect()), key=str) == sorted(((a, p, r, n, 131072, 131072) for a, p5 in ((0, (2, 4, 6, 8, 10)), (50, (0, 2, 4, 6, 8))) for p in p5 for r, n in enumerate((1, 3, 5), 1)), key=str)
    assert hard_negatives.mine(made.limit(0)).count() == 0
    assert hard_negatives.mine(made.where("vec_id % 50 <> 0")).count() == 0


def test_mining_exact_beyond_doubles():
    import numpy as np

    a, b = np.array([[2.0**30 + 1, 3.0]]), np.array([[2.0**30 + 3, -5.0]])
    assert hard_negatives._scores(a, b).tolist() == [[(2**30 + 1) * (2**30 + 3) - 15]]
    with pytest.raises(OverflowError):
        hard_negatives._scores(np.array([[2.0**40]]), np.array([[2.0**40]]))
