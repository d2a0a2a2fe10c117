"""The join against all pairs, compared one by one."""

import random

import pytest

from barloom.llm.ngram_join import keep_first, ngram_jaccard_join


def brute(rows, k, num, den):
    def shingles(text):
        words = (text or "").encode().lower().split()
        if not words:
            return set()
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}

    sets = [shingles(t) for _, t in rows]
    group, links = list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    low = {}
    for g, (i, _) in zip(group, rows):
        low[g] = min(low.get(g, i), i)
    return sorted((i, len(s), low[g], n) for (i, _), s, g, n in zip(rows, sets, group, links))


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for _ in range(40):
        base = [r.choice(words) for _ in range(r.choice([1, 2, 3, 9, 10, 12, 30, 60, 200]))]
        for _ in range(r.choice([1, 1, 2, 8])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2])):
                copy[r.randrange(len(copy))] = r.choice(words)
            if r.random() < 0.2:
                copy = copy[: max(1, len(copy) - 3)]
            rows.append(" ".join(x.upper() if r.random() < 0.1 else x for x in copy))
    r.shuffle(rows)
    return list(enumerate([*rows, None, "", " \n ", "É é É é", "é É é É", "a b", "A B"]))


@pytest.mark.parametrize(("seed", "k", "num", "den", "chunk"), [(2, 5, 80, 100, 2_000_000), (3, 3, 90, 100, 150), (4, 2, 1, 2, 300)])
def test_against_all_pairs(spark, seed, k, num, den, chunk):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, k, num, den)
    got = sorted(tuple(r) for r in ngram_jaccard_join(df, k, (num, den), chunk_ngrams=chunk).collect())
    assert got == want
    if chunk > 1000:
        return
    light = ngram_jaccard_join(df, k, (num, den), chunk_ngrams=chunk, count_links=False).collect()
    assert sorted(tuple(r)[:3] for r in light) == [x[:3] for x in want] and {r["n_links"] for r in light} <= {None, 0}
    kept = keep_first(df, k, (num, den), chunk_ngrams=chunk)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, n, low, _ in want if i == low or not n)


def test_large_groups_in_chunks(spark):
    r = random.Random(9)
    base = [[f"{g}w{i}" for i in range(60)] for g in range(2)]
    rows = []
    for i in range(150):
        words = list(base[i % 2])
        for _ in range(r.choice([0, 1, 2, 3])):
            words[r.randrange(60)] = f"x{i}"
        rows.append((i, " ".join([*words, *(base[1 - i % 2][: i % 23] if i > 140 else [])])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 3, 70, 100)
    assert sorted(tuple(r) for r in ngram_jaccard_join(df, 3, (70, 100), chunk_ngrams=400).collect()) == want
    light = ngram_jaccard_join(df, 3, (70, 100), chunk_ngrams=400, count_links=False).collect()
    assert sorted(tuple(r)[:3] for r in light) == [x[:3] for x in want]


def test_texts_of_one_id_are_one_document(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    got = ngram_jaccard_join(spark.createDataFrame([(0, a), (1, a), (1, b), (2, b), (2, ""), (4, "other words stand here in line")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == [(0, 2, 0), (1, 2, 0), (1, 2, 0), (2, 0, 2), (2, 2, 0), (4, 2, 4)]


def test_keep_first(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(3, a, "x"), (3, a, "y"), (5, a, "z"), (None, a, "n"), (None, b, "n"), (None, b, "m"), (7, None, "p"), (7, "", "q"), (8, " ", "r"), (9, "seven eight", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").withColumnRenamed("key", "hit").selectExpr("*", "1 as key", "2 as n", "3 as low", "4 as _p", "5 as stays")
    got = keep_first(df)
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(3, a), (None, b), (7, None), (7, ""), (8, " "), (9, "seven eight")], key=str)
    assert keep_first(df.where("false")).count() == 0


def test_edges(spark):
    empty = ngram_jaccard_join(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.columns == ["doc_id", "n_shingles", "component_id", "n_links"] and empty.count() == 0
    rows = [(1, "a b c d e f", 5), (1, "a b c d e f", 6), (None, "a b c d e f", 7), (3, None, 8), (None, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").withColumnRenamed("n", "component_id")
    got = sorted((tuple(r) for r in ngram_jaccard_join(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, 2), (1, 2, 1, 2), (None, 2, 1, 2), (3, 0, 3, 0), (None, 0, None, 0)], key=str)
