"""Each operator against plain code, an exact round trip or held-out labels, and on empty, null and repeated rows."""

import base64
import collections
import hashlib
import json
import math
import random
import re
import time
import unicodedata
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from barloom.llm import chat_format, fingerprint, license_scan, packing, quality_rules, queries, sentencepiece_codec, toxicity, url_filter, warc
from barloom.llm._common import with_range_cells

DIRECTORY = "/root/testdata/sf0.001"
ODD = [(1, "a b", 9), (1, "a b", 9), (None, "x", 8), (3, None, 7), (4, "", 6), (5, "é" * 5000, 5)]
TEXTS = "doc_id long, text string, n_words long"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DIRECTORY}/documents.parquet").collect()}


def odd(spark):
    return spark.createDataFrame(ODD, TEXTS)


def none(spark):
    return spark.createDataFrame([], TEXTS)


def test_fingerprints(spark, docs, monkeypatch):
    monkeypatch.setattr(fingerprint, "CELL_CHARS", 40_000)
    out = {r["doc_id"]: r for r in queries.op1_fingerprints(spark, DIRECTORY).collect()}
    order = sorted(docs, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    first = {}
    for i in sorted(docs):
        first.setdefault(docs[i], i)
    assert out.keys() == docs.keys()
    for i, r in out.items():
        text, other = docs[i], docs[after[i]]
        k = len(text) // 3
        edited = text[: len(text) - k] + other[:k]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_next"] == float(r["fingerprint"] == out[after[i]]["fingerprint"])
        assert r["near_edited"] == float(r["fingerprint"] == r["edited_fingerprint"])
        assert r["class_id"] == first[text]


def test_fingerprints_fold(spark):
    rows = [(1, "Caf\u00e9  STRASSE\n"), (2, " cafe\u0301 stra\u00dfe"), (3, "\uff43af\u00e9\u00a0strasse"), (4, "cafe strasse"), (5, None), (6, "")]
    out = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i]["class_id"] for i in range(1, 7)] == [1, 1, 1, 4, 5, 5]
    assert fingerprint.edited_fingerprints(none(spark)).count() == 0
    assert fingerprint.edited_fingerprints(odd(spark)).count() == len(ODD)
    assert fingerprint.edited_fingerprints(odd(spark).limit(1)).first()["near_next"] == 1.0


def test_fingerprints_of_many_null_ids(spark, monkeypatch):
    """Half of the rows have no id: they stand last by text hash, and no cell holds them all."""
    monkeypatch.setattr(fingerprint, "CELL_CHARS", 2_000)
    rows = [(i if i % 2 else None, f"text number {i} " + "x" * (i % 13)) for i in range(900)] + [(None, "again"), (None, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ties = {r["text"]: r["tie"] for r in df.select("text", F.xxhash64("text").alias("tie")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), ties[r[1]]))
    want = sorted(((i or -1, t, order[(n + 1) % len(order)][1]) for n, (i, t) in enumerate(order)))
    seen = []
    real = fingerprint.with_range_cells
    monkeypatch.setattr(fingerprint, "materialize", lambda x: (seen.append(x), x)[1])
    got = fingerprint.with_next(df.withColumn("tie", F.xxhash64("text")), ["text"])
    assert sorted((r["doc_id"] or -1, r["text"], r["next_text"]) for r in got.collect()) == want
    assert seen[0].where("cell < 0").count() > 4 and real is fingerprint.with_range_cells
    out = fingerprint.edited_fingerprints(df)
    assert out.count() == len(rows)


def test_toxicity(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scored = toxicity.score(docs, labels)
    rows = {r["doc_id"]: r for r in scored.collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    held = [(rows[r["doc_id"]]["predicted"], r["toxic"]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    caught, flagged, toxic = (sum(1 for p, t in held if c(p, t)) for c in (lambda p, t: p and t, lambda p, t: p and not t, lambda p, t: t))
    assert caught / toxic >= 0.6 and caught / (caught + flagged) >= 0.8
    assert toxicity.score(none(spark), labels).count() == 0
    assert {r["score"] for r in toxicity.score(odd(spark), labels.where("false")).collect()} == {0.0}


def test_toxicity_weights_leave_their_own_fold_out():
    rng = np.random.default_rng(5)
    positive = {x: rng.integers(0, 9, toxicity.FOLDS) for x in "abcdefgh"}
    negative = {x: rng.integers(0, 20, toxicity.FOLDS) for x in "abcdef"}
    taught = np.array([[100] * toxicity.FOLDS, [20] * toxicity.FOLDS])
    found = [toxicity._weights(positive, negative, taught, 5, 0.002, f) for f in (None, *range(toxicity.FOLDS))]
    for f in range(toxicity.FOLDS):
        other = [{x: np.where(np.arange(toxicity.FOLDS) == f, 99, ns) for x, ns in counts.items()} for counts in (positive, negative)]
        assert toxicity._weights(*other, taught, 5, 0.002, f) == found[f + 1]
    base, k, n = 1 / 6, int(positive["a"].sum()), int(negative["a"].sum())
    odds = np.log((k + 10 * base) / (n + 10 * (1 - base))) - np.log(base / (1 - base))
    assert found[0].get("a", 0.0) == pytest.approx(odds if odds > 0.5 else 0.0)
    assert toxicity._weights(positive, negative, np.array([[4] * toxicity.FOLDS, [0] * toxicity.FOLDS]), 5, 0.002) == {}


def test_toxicity_with_few_teachers(spark):
    """With fewer toxic rows than least_docs, what all of them have still tells."""
    rows = [(i, f"common words number {i} and {'moron' if i % 20 == 0 else 'neighbour'} again") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 20 == 0)) for i in range(300)], "doc_id long, toxic int")
    fitted = toxicity.fit(docs, labels, least_docs=50)
    assert "=moron" in fitted[0]["weights"] and "=common" not in fitted[0]["weights"] and len(fitted[1]) == 5
    scores = {r["doc_id"]: r["score"] for r in toxicity.apply(docs, fitted).collect()}
    assert min(s for i, s in scores.items() if i % 20 == 0) > max(s for i, s in scores.items() if i % 20)
    one_of_each = labels.where("doc_id in (20, 21)")  # no fold has both classes: no evidence, and no failure
    assert {0 <= r["score"] <= 1 for r in toxicity.score(docs, one_of_each).collect()} == {True}


def test_deobfuscation(spark):
    text = " ".join(["the idiot moron was a pathetic clown and stupid loser in the trash"] * 50)
    lm = toxicity.language_model(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    restore = lambda w: toxicity.decode(w, lm, True) if " " in w else toxicity.restore_word(w, lm)
    assert toxicity.restored_words("The 1d10t, m0ronnn! $tupid p@thetic i d i o t c.l.o.w.n", restore) == ["the", "idiot", "moron", "stupid", "pathetic", "idiot", "clown"]
    assert toxicity.restored_words(None, restore) == []


def test_licenses(spark):
    rows = [(1, "x MIT License y mit-license; z"), (2, "Under the GNU General, Public License"), (3, "mit licenses"), (4, "Licensed under the Apache  License, Version 2.0."), *[(10 + i, t) for i, (_, t) in enumerate(license_scan.TEMPLATES)]]
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        w = words.findall("".join(c.lower() if c.isascii() else c for c in text))
        at = [(j, label) for p, label in license_scan.PHRASES.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min((j for j, _ in at), default=None), max((j for j, _ in at), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        if i >= 10:
            assert license_scan.TEMPLATES[i - 10][0] in r["labels"].split(",") and r["score"] == 1.0
    assert license_scan.scan(none(spark)).count() == 0
    assert sorted((r["doc_id"] or 0, r["n_words"]) for r in license_scan.scan(odd(spark)).collect()) == [(0, 1), (1, 2), (1, 2), (3, 0), (4, 0), (5, 1)]


def test_licenses_survive_edits(spark):
    label, text = license_scan.TEMPLATES[0]
    w = text.split()
    edited = " ".join([*w[:8], "really", *w[8:15], *w[16:]])
    assert label in license_scan.scan(spark.createDataFrame([(1, edited)], "doc_id long, text string")).first()["labels"]


def test_urls(spark):
    con = duckdb.connect()
    rows = [(1, None, 0), (2, "no scheme", 0), (3, "http://A.Com/en/x", 0), (4, "x://example.net/de/8?q", 0), (5, "http://u:p@example.org:80/es/#f", 0), (6, "http://z/free-casino", 0), (7, "http://z/xxx", 0), (8, "http://z/freecasino", 0), (8, "http://z/freecasino", 0), (9, "ftp://com", 0), (10, "http://", 0), (11, "a://b://c/en/", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule int")
    got = url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict").collect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", [r[:2] for r in rows])
    cur = con.execute(queries.oracle_sql()["op4_url_filter"])
    names = [x[0] for x in cur.description]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str(tuple(r[names.index(c)] for c in ("page_id", "host", "path", "rule", "verdict"))) for r in cur.fetchall())
    assert {r["page_id"]: r["verdict"] for r in got}[6] == "block" and url_filter.judge(pages.where("false")).count() == 0


def test_quality(spark, docs):
    out = {r["doc_id"]: r for r in queries.op5_quality_rules(spark, DIRECTORY).collect()}
    for i, text in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = collections.Counter(tuple(words[j : j + 5]) for j in range(len(words) - 4))
        hit = {j + k for j in range(len(words) - 4) if windows[tuple(words[j : j + 5])] > 1 for k in range(5)}
        lines, dup = set(), 0
        for line in text.split("\n"):
            dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines
            lines.add(line)
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit))
        assert r["base_failed"] == (len(words) < 10 or 100 * len(hit) > 20 * len(words)) and not (r["kept"] and r["base_failed"])
    assert quality_rules.judge(none(spark)).count() == 0
    assert {r["kept"] for r in quality_rules.judge(odd(spark)).collect()} == {False}


def test_quality_em_finds_the_reliable_rules():
    r = random.Random(1)
    patterns = collections.Counter()
    for _ in range(4000):
        good = r.random() < 0.8
        patterns[tuple((1 if good else -1) if r.random() < p else 0 if r.random() < 0.5 else (-1 if good else 1) * (1 if r.random() < 0.2 else 0) for p in (0.9, 0.7, 0.6))] += 1
    share, p = quality_rules.fit(sorted(patterns.items()))
    assert abs(share - 0.8) < 0.08 and p[0, 0, 0] > 0.75 and p[1, 0, 2] > 0.75


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = queries.op6_best_fit_packing(spark, DIRECTORY).collect()
    pieces, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == docs.keys()
    for i, rows in pieces.items():
        ids = [*tok.encode(docs[i], add_special_tokens=False).ids, 0]
        rows.sort(key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(rows):
            raw = b"".join(x.to_bytes(4, "little") for x in ids[at : at + r["length"]])
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(raw)) and (k == 0 or r["length"] == 2048)
            at += r["length"]
        assert at == len(ids)
    for x in places.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-sum(r["length"] for r in got) // 2048) * 1.02 + 1
    assert packing.pack(none(spark)).count() == 0 and packing.pack(odd(spark)).count() >= len(ODD)
    assert packing.encode("a<|endoftext|>b", public_tokenizers.path("byte_bpe_50k.json")).tolist() == [*tok.encode("a<|endoftext|>b", add_special_tokens=False).ids, 0]


def test_plans_hold_every_piece():
    r = random.Random(3)
    for _ in range(200):
        cap = r.choice([10, 20, 50])
        counts = collections.Counter(r.randint(1, cap) for _ in range(r.choice([1, 5, 20, 200])))
        rest = collections.Counter(counts)
        bins = packing.reduce_by_dominance(rest, cap) + packing.best_fit(rest, cap)
        held = collections.Counter()
        for lengths, n in bins:
            assert sum(lengths) <= cap and n > 0
            for x in lengths:
                held[x] += n
        assert held == counts


def test_warc(spark):
    rows = [(r["page_id"], r["url"], r["html"], 1) for r in spark.read.parquet(f"{DIRECTORY}/pages.parquet").collect()]
    rows += [(1000 + i, "http://a/\nb", h, 1) for i, h in enumerate([None, "", rows[0][2], "é" * 50_000, "é" * 50_000])]
    out = warc.archive_and_read(spark.createDataFrame(rows, "page_id long, url string, html string, refers_to int")).collect()
    last = {h or "": i for i, _, h, _ in sorted(rows)}
    want = []
    for i, _, h, _ in rows:
        raw, to = (h or "").encode(), last[h or ""]
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if to == i else "revisit", None if to == i else to))
    assert sorted(tuple(r)[:5] for r in out) == sorted(want) and all(r["verified"] for r in out if r["record_type"] == "response")
    assert warc.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_pushdown_and_plain_records(spark, tmp_path):
    data = warc.record("response", "urn:a", "http://a", None, b"one") + warc.record("revisit", "urn:b", None, "urn:a", b"one")
    (tmp_path / "x.warc").write_bytes(data)
    (tmp_path / "y.warc.gz").write_bytes(b"".join(warc.gzip_member(warc.record("response", f"urn:{i}", "u", None, b"z" * i * 9000)) for i in range(4)))
    df = warc.read_archive(spark, f"file://{tmp_path}")
    assert sorted((r["record_id"], len(r["payload"] or b"")) for r in df.collect()) == [("urn:0", 0), ("urn:1", 9000), ("urn:2", 18000), ("urn:3", 27000), ("urn:a", 3), ("urn:b", 0)]
    one = df.where("record_type = 'response' and record_id in ('urn:a', 'urn:2')")
    assert sorted(r["record_id"] for r in one.collect()) == ["urn:2", "urn:a"]
    assert warc.read_archive(spark, f"file://{tmp_path}", payload=False).where("record_type = 'revisit'").first()["payload_length"] == 3


def test_sentencepiece(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.codec(path)
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz  ,.ABCéñ日本\n12 ▁😀\u0301"
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 30)))
        assert own.encode(text) == sp.encode(text)
    long = "".join(r.choice("abcdeinorstth") for _ in range(20_000))
    assert [own.ids[p] for p in own.segments(sentencepiece_codec.SPACE + long, 32)] == sp.encode(long)
    rows = {x["doc_id"]: x for x in queries.op8_sentencepiece(spark, DIRECTORY).collect()}
    for x in spark.read.parquet(f"{DIRECTORY}/documents.parquet").collect():
        ids = sp.encode(x["text"] or "")
        assert rows[x["doc_id"]]["n_ids"] == len(ids) and rows[x["doc_id"]]["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)) and rows[x["doc_id"]]["restored"]
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(odd(spark)))
    assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=str) == sorted(((i, t or "") for i, t, _ in ODD), key=str)
    assert sentencepiece_codec.round_trip(none(spark)).count() == 0


def test_chat(spark):
    messages = spark.createDataFrame([(1, 0, "user", "hé"), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    calls = spark.createDataFrame(
        [(1, 1, "b", "f", '{"n":2,"a":"x"}', ["a"]), (1, 1, "a", "f", '{"n":"two"}', []), (1, 1, "c", "g", "{", ["d"]), (1, 1, "d", "f", "{}", ["c"]), (1, 2, "b", "f", "{}", []), (1, 1, None, "f", '{"n":1}', None)],
        "conv_id long, turn long, call_id string, name string, arguments string, parents array<string>",
    )
    results = spark.createDataFrame([(1, "a", "ok"), (1, "a", "again"), (1, "zz", "lost")], "conv_id long, call_id string, text string")
    schemas = {"f": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer"}}}}
    got = {(r["part"], r["call_id"], r["line"]): r for r in chat_format.format_conversations(messages, calls, results, schemas).collect()}
    by = lambda part, call: [r for (p, c, _), r in got.items() if p == part and c == call]
    assert len(got) == 2 + 5 + 3
    assert by(1, "b")[0]["line"] == '{"role":"assistant","tool_call":{"after":["a"],"arguments":{"a":"x","n":2},"id":"b","name":"f"}}'
    assert (by(1, "b")[0]["step"], by(1, "b")[0]["status"], by(1, "a")[0]["step"], by(1, "a")[0]["status"], by(1, "a")[0]["problem"]) == (1, "pending", 0, "linked", "$.n: not integer")
    assert {by(1, c)[0]["status"] for c in "cd"} == {"cycle"} and "unknown tool" not in (by(1, "d")[0]["problem"] or "")
    assert {r["status"] for r in by(2, "a")} == {"linked"} and by(2, "zz")[0]["status"] == "orphan"
    assert any(r["line"] == '{"content":"hé","role":"user"}' for r in got.values())
    empty = chat_format.format_conversations(messages.where("false"), calls.where("false"), results.where("false"), schemas)
    assert empty.count() == 0


def test_derived_calls_hold_whole_texts(spark):
    text = "word é \"q\" " * 30
    turns = spark.createDataFrame([(c, t, ("user", "assistant")[t % 2], f"{text}{c} {t}") for c in range(6) for t in range(4)], "conv_id long, turn long, role string, text string")
    calls, results = chat_format.derived_calls(turns)
    asked = calls.collect()
    assert {r["name"] for r in asked} == {"search", "count_words", "translate"}
    for r in asked:
        found = json.loads(r["arguments"])
        assert found["query" if r["name"] == "search" else "text"] == f"{text}{r['conv_id']} {r['turn']}"
    assert sorted(r["text"] for r in results.collect()) == sorted(f"{text}{c} 2" for c in range(6))
    lines = [json.loads(r["line"]) for r in chat_format.format_conversations(turns, calls, results, chat_format.SCHEMAS).collect()]
    assert all(len(x["content"]) > 300 for x in lines if "content" in x) and len(lines) == 24 + 12 + 6


def test_like_licenses_are_told_apart(spark):
    texts = {"gpl": "you may use it under the terms of the GNU General Public License as it stands", "lgpl": "under the terms of the GNU Lesser General Public License", "cc-by-4.0": "licensed under CC BY 4.0", "cc-by-nc-4.0": "licensed under CC BY NC 4.0", "cc-by-sa-4.0": "licensed under CC BY SA 4.0", "cc-by-sa-3.0": "licensed under CC BY-SA 3.0", "cc-by-nd-4.0": "licensed under CC BY-ND 4.0", "agpl": "under the terms of the GNU Affero General Public License", "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "gpl-2": "either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful", "gpl-3": "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful"}
    rows = list(enumerate(texts.values()))
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, label in enumerate(texts):
        assert label in got[i] and not got[i] & (set(texts) - {label, "gpl"})
    words = license_scan.TEMPLATES[0][1].split()
    pairs = " ".join(x for i in range(len(words) - 2, -1, -1) for x in words[i : i + 2])
    assert license_scan.scan(spark.createDataFrame([(1, pairs)], "doc_id long, text string")).first()["labels"] == ""
    assert license_scan.aligned([(p << 32) + q for p, q in [(0, 1), (2, 0)]]) == 1


def test_the_best_of_overlapping_licenses_wins():
    span = lambda label, first, last, held: {"label": label, "first_word": first, "last_word": last, "held": held}
    assert license_scan.best_spans([span("a", 0, 9, 9), span("b", 4, 12, 6), span("b", 20, 28, 6)]) == ["a", "b"]
    assert license_scan.best_spans([span("a", 0, 9, 9), span("b", 4, 12, 6), span("c", 9, 12, 3)]) == ["a", "c"]
    assert license_scan.best_spans([span("a", 0, 100, 90), span("a", 10, 12, 9), span("b", 13, 20, 8)]) == ["a"]
    r = random.Random(4)
    for _ in range(300):
        spans = [span(r.choice("abc"), f := r.randrange(60), f + r.randrange(1, 20), r.randrange(1, 30) + i / 100) for i in range(r.randrange(12))]
        taken: list[dict] = []
        for s in sorted(spans, key=lambda x: -x["held"]):
            inside = lambda t: sum(t["first_word"] <= w <= t["last_word"] for w in range(s["first_word"], s["last_word"] + 1))  # noqa: B023, E731
            joined = lambda t: {w for u in taken if u["label"] == t["label"] for w in range(u["first_word"], u["last_word"] + 1)}  # noqa: B023, E731
            runs = {}
            for t in taken:
                if t["label"] != s["label"]:
                    w = joined(t)
                    lo, hi = t["first_word"], t["last_word"]
                    while lo - 1 in w and any(u["first_word"] <= lo - 1 and lo <= u["last_word"] for u in taken if u["label"] == t["label"]):
                        lo -= 1
                    while hi + 1 in w and any(u["first_word"] <= hi and hi + 1 <= u["last_word"] for u in taken if u["label"] == t["label"]):
                        hi += 1
                    runs[t["label"], lo] = {"first_word": lo, "last_word": hi}
            if all(2 * inside(t) < s["last_word"] - s["first_word"] + 1 for t in runs.values()):
                taken.append(s)
        assert license_scan.best_spans(spans) == sorted({t["label"] for t in taken})


def brute_chat(messages, calls, results, schemas):
    """Rows as the docstring of format_conversations says, by plain loops."""
    one = {}
    for c in calls:
        if c[2] is not None:
            key = (c[0], c[2])
            rank = (c[1], c[3], c[4], c[5] or [])
            one[key] = min(one.get(key, rank), rank)
    step = {k: None for k in one}
    while True:
        new = {k: 1 + max((step[k[0], p] for p in ps if (k[0], p) in one), default=-1) for k, (_, _, _, ps) in one.items() if step[k] is None and all(step[k[0], p] is not None for p in ps if (k[0], p) in one)}
        if not new:
            break
        step |= new
    answered = {(c, i) for c, i, _ in results if i is not None}
    rows = [(c, t, -1, 0, None, "message") for c, t, _, _ in messages]
    rows += [(c[0], c[1], 0, 1, None, "pending") for c in calls if c[2] is None]
    rows += [(k[0], v[0], step[k], 1, k[1], "cycle" if step[k] is None else "linked" if k in answered else "pending") for k, v in one.items()]
    rows += [(c, one[c, i][0], step[c, i], 2, i, "linked") if (c, i) in one else (c, None, None, 2, i, "orphan") for c, i, _ in results]
    return sorted(rows, key=str)


@pytest.mark.parametrize("whole", [10_000, 3])
def test_chat_against_plain_code(spark, whole, monkeypatch):
    r = random.Random(whole)
    convs = [0, 1, 2, 3, None]
    messages = [(c, t, "user", f"m{t}") for c in convs for t in range(3)] + [(None, None, "user", "m"), (1, 0, "user", "m0"), (1, 0, "user", "m0")]
    calls = [(c, t, f"{i}" if i % 9 else None, "f", "{}", [f"{r.randrange(25)}" for _ in range(r.randrange(3))]) for c in convs for t in range(3) for i in range(12)]
    calls += [(9, 0, f"{i}", "f", "{}", [f"{i - 1}"]) for i in range(12)]  # one long chain
    results = [(c, f"{r.randrange(14)}", "x") for c in convs for _ in range(10)] + [(1, None, "y"), (None, None, "y")]
    real = chat_format.order_calls
    monkeypatch.setattr(chat_format, "order_calls", lambda one: real(one, whole))
    out = chat_format.format_conversations(
        spark.createDataFrame(messages, "conv_id long, turn long, role string, text string"),
        spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, parents array<string>").withColumn("step", F.lit("x")).withColumn("status", F.lit("x")),
        spark.createDataFrame(results, "conv_id long, call_id string, text string").withColumn("turn", F.lit("x")), {"f": {}},
    )
    assert sorted(((x["conv_id"], x["turn"], x["step"], x["part"], x["call_id"], x["status"]) for x in out.collect()), key=str) == brute_chat(messages, calls, results, {})


def test_json_schema_equality():
    assert chat_format.problems(1.0, {"type": "integer"}) == [] and chat_format.problems(1.5, {"type": "integer"})
    assert chat_format.problems(True, {"enum": [1]}) and chat_format.problems([{"a": False}], {"enum": [[{"a": 0}]]})
    assert chat_format.problems(1.0, {"enum": [1]}) == [] and chat_format.problems([{"a": 1}], {"enum": [[{"a": 1.0}]]}) == []


def test_chat_arguments_that_are_no_values(spark):
    bad = ['{"n":1e999}', '{"a":"\\ud800"}', "[" * 100_000, "", "NaN", '{"n":' + "9" * 5000 + "}"]
    calls = [(1, i, str(i), "f", a, None) for i, a in enumerate([*bad, '{"z":-0,"b":1.0,"b":2.50,"é":"x"}', '{"t":"' + "long " * 200_000 + '"}'])]
    out = chat_format.format_conversations(
        spark.createDataFrame([], "conv_id long, turn long, role string, text string"), spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, parents array<string>"),
        spark.createDataFrame([], "conv_id long, call_id string, text string"), {"f": {}},
    )
    got = {r["turn"]: r for r in out.collect()}
    assert all(got[i]["problem"] == "$: not JSON" and json.loads(got[i]["line"])["tool_call"]["arguments"] == a for i, a in enumerate(bad))
    assert '"arguments":{"b":2.5,"z":0,"é":"x"}' in got[len(bad)]["line"] and len(got[len(bad) + 1]["line"]) > 1_000_000


def test_warc_of_repeated_ids(spark, tmp_path):
    rows = [(5, "A"), (5, "B"), (7, "A"), (9, "B"), (9, "B"), (None, "A")]
    df = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")
    got = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0, r["payload_digest"]) for r in warc.archive_and_read(df).collect())
    a, b = (base64.b32encode(hashlib.sha1(x).digest()).decode() for x in (b"A", b"B"))
    assert got == [(0, "response", 0, a), (5, "revisit", 7, a), (5, "revisit", 9, b), (7, "response", 0, a), (9, "response", 0, b), (9, "response", 0, b)]
    path = f"file://{tmp_path}/w"
    for mode, n in (("append", 6), ("append", 12), ("overwrite", 6)):
        warc.write_archive(df, path, mode=mode)
        assert warc.read_archive(spark, path).count() == n


def test_encoder_against_the_library():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        own = packing.Encoder(public_tokenizers.path(name))
        assert (own.fast is None) == (name[0] == "w")
        r = random.Random(2)
        for _ in range(3000):
            text = "".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x20, 0x250), r.randrange(0x250, 0xD7FF), r.randrange(0xE000, 0x11FFF), 32, 32, 10, 0x1C, 0x85, 0xA0])) for _ in range(r.randrange(40)))
            assert own.ids(text) == own.whole.encode(text, add_special_tokens=False).ids
        for text in ("x" + " " * 1_000_000 + "y", "a" * 1_000_000):
            assert own.ids(text) == own.whole.encode(text, add_special_tokens=False).ids


def readings(span, gaps):
    """Every reading of a span with its channel cost."""
    found = {"": 0.0}
    for i, c in enumerate(span):
        arcs = [(c, 0.0), *((x, toxicity.SUBSTITUTION) for x in toxicity.LEET.get(c, ""))]
        if gaps and c in toxicity._GAPS:
            arcs.append(("", toxicity.GAP))
        elif i and c == span[i - 1] and c.isalpha():
            arcs.append(("", toxicity.STRETCH if c in (span[i - 2 : i - 1], span[i + 1 : i + 2]) else toxicity.DOUBLED))
        new = {}
        for text, cost in found.items():
            for letter, more in arcs:
                new[text + letter] = min(new.get(text + letter, 1e9), cost + more)
        found = new
    return found


def test_decoder_against_all_readings(spark):
    lm = toxicity.language_model(spark.createDataFrame([(1, " ".join(["the idiot moron was a stupid loser in trash"] * 30))], "doc_id long, text string"))
    r = random.Random(6)

    def score(text):
        at = [0, 0, *(int(toxicity._CLASS_OF[min(ord(c), 65535)]) for c in text), 0]
        return sum(float(lm[at[i], at[i + 1], at[i + 2]]) for i in range(len(at) - 2))

    for _ in range(200):
        gaps = r.random() < 0.5
        span = "".join(r.choice("idot1i0s$@.-a") for _ in range(r.randrange(1, 8)))
        every = {t: score(t) - c for t, c in readings(span, gaps).items()}
        assert abs(every[toxicity.decode(span, lm, gaps)] - max(every.values())) < 1e-4
    assert toxicity.decode("s" + "t" * 1_000_000 + "upid", lm, False) == "stupid"


def test_fingerprint_digest_against_unicodedata(spark):
    r = random.Random(8)
    alphabet = [*"aAbBßİıſ 1", "\u0301", "\u00a0", "\u3000", "ﬁ", "Ⅷ", "ａ", "Σ", "ς", "e\u0301", "\t", "\n"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(8))) for _ in range(400)]
    canon = lambda t: " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprint.edited_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(canon(t), set()).add(got[i])
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


def test_fingerprint_cells_of_outlying_ids(spark):
    df = spark.range(3000).selectExpr("case when id = 0 then 4000000000000000000 when id % 50 = 1 then null else id end as doc_id")
    sizes = [r["count"] for r in with_range_cells(df, "doc_id", 16).groupBy("cell").count().collect()]
    assert max(sizes) < 450 and len(sizes) >= 12


def test_one_very_long_text(spark):
    rows = [(1, "word " * 200_000, "http://a/" + "x" * 1_000_000), (2, "x" * 1_000_000, None), (3, "MIT license, " * 80_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, url string")
    assert fingerprint.edited_fingerprints(docs).count() == 3
    assert {r["n_words"] for r in quality_rules.judge(docs).collect()} == {200_000, 1, 160_000}
    assert {r["doc_id"]: r["n_base"] for r in license_scan.scan(docs).collect()} == {1: 0, 2: 0, 3: 80_000}
    assert packing.pack(docs).where("doc_id = 2").count() > 1
    assert all(r["restored"] for r in sentencepiece_codec.round_trip(docs).collect())
    assert toxicity.score(docs, spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, toxic int")).count() == 3
    assert url_filter.judge(docs, id_col="doc_id").count() == 3
    assert warc.archive_and_read(docs.selectExpr("doc_id as page_id", "url", "text as html")).where("verified").count() == 3


@pytest.mark.parametrize("word, gap", [("a" * 1999, " "), ("é" * 1999, "\n"), ("ab", " " * 1999), ("a" * 2000, " "), ("a", " " * 2000)])
def test_long_runs_are_found_in_one_pass(word, gap):
    own = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    text = gap.join([word] * 500)
    start = time.perf_counter()
    found = own.long.search(text)
    assert time.perf_counter() - start < 1 and bool(found) == (max(len(word), len(gap)) >= 2000)


def test_dominance_against_exact_packing():
    def fewest(items, cap):
        items = sorted(items, reverse=True)
        best = [len(items)]

        def place(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for j in {b: j for j, b in enumerate(bins)}.values():
                if bins[j] >= items[i]:
                    bins[j] -= items[i]
                    place(i + 1, bins)
                    bins[j] += items[i]
            place(i + 1, [*bins, cap - items[i]])

        place(0, [])
        return best[0]

    r = random.Random(11)
    for _ in range(400):
        cap = r.choice([10, 13, 20])
        items = [r.randint(1, cap) for _ in range(r.randint(1, 9))]
        rest = collections.Counter(items)
        fixed = packing.reduce_by_dominance(rest, cap)
        assert sum(n for _, n in fixed) + fewest(list(rest.elements()), cap) == fewest(items, cap)


def test_quality_posterior_against_plain_bayes(spark, docs):
    judged = quality_rules.judge(spark.read.parquet(f"{DIRECTORY}/documents.parquet")).collect()
    names = [c for c in judged[0].asDict() if c.startswith("vote_")]
    votes = [tuple(r[c] for c in names) for r in judged]
    good, p = quality_rules.fit(sorted(collections.Counter(votes).items()))
    for r, v in zip(judged, votes):
        like = [(1 - good, good)[c] * math.prod(p[c, j, x + 1] for j, x in enumerate(v)) for c in (0, 1)]
        assert abs(r["quality"] - like[1] / sum(like)) < 1e-9 and r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5)
