"""License passages by diagonal voting: word k-grams meet template positions in a join, and diagonals gather votes.

Every rolling word k-gram of every text is a row; a join with the templates' k-grams gives pairs of positions. Those
of one passage lie on one diagonal (document position less template position), or on neighbouring ones where words
were added or left out. Votes are summed by diagonal before and after the shuffle, neighbouring diagonals are merged,
and a span counts if it holds enough of its template in order.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from barloom.llm._common import worker_cache

#: Phrases whose every place is reported, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Passages of well-known public license texts, and their labels: the family, and the version where the words name one.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-3", "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful"),
    ("gpl-2", "either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("epl-1.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("boost", "boost software license version 1 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    *((f"cc-{kind.replace(' ', '-')}-{version}.0", f"licensed under cc {kind} {version} 0") for kind in ("by", "by nc", "by nd", "by sa", "by nc nd", "by nc sa") for version in (3, 4)),
]

#: Words of a k-gram; the shortest phrase has two.
K = 2
#: The share of a template's k-grams that a span must hold, and how far the diagonals of one span may lie apart.
LEAST_COVER, GAP = 0.7, 3
#: Template k-grams that may be broadcast; beyond this the join shuffles.
BROADCAST_GRAMS = 1_000_000

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CACHED_WORDS = 250_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().lower())


def gram_hashes(found: list[bytes], k: int = K) -> np.ndarray:
    if len(found) < k:
        return np.zeros(0, np.int64)
    hashes = worker_cache("license words", _WordHashes)
    if len(hashes) > CACHED_WORDS:
        hashes.clear()
    w = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for j in range(k):
        x = w[j : j + len(h)] * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, n_words, position, gram): a row of position -1 for each text, then one for each of its k-grams."""
    for b in batches:
        texts = b.column("text").to_pylist()
        for i in range(0, len(texts), 500):
            at, gram, size = [], [], []
            for t in texts[i : i + 500]:
                found = words(t)
                h = gram_hashes(found)
                size.append(len(found))
                at.append(np.arange(-1, len(h), dtype=np.int32))
                gram.append(np.concatenate([np.zeros(1, np.int64), h]))
            which = np.repeat(np.arange(i, i + len(at)), [len(x) for x in at])
            taken = [b.column(c).take(pa.array(which)) for c in ("row", "doc_id")]
            counts = pa.array(np.repeat(np.array(size, np.int32), [len(x) for x in at]))
            yield pa.RecordBatch.from_arrays([*taken, counts, pa.array(np.concatenate(at)), pa.array(np.concatenate(gram))], names=["row", "doc_id", "n_words", "position", "gram"])


def template_rows(phrases: dict[str, str], templates: list[tuple[str, str]]) -> list[tuple]:
    """(template, base, label, n_grams, place, gram) for each k-gram; template -1 is met by each text's first row."""
    rows = [(-1, False, "", 1, 0, 0)]
    for i, (base, label, text) in enumerate([*((True, v, k) for k, v in phrases.items()), *((False, v, t) for v, t in templates)]):
        h = gram_hashes(words(text))
        rows += [(i, base, label, len(h), j, int(x)) for j, x in enumerate(h)]
    return rows


def spans(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n_words, template, base, label, n_grams, first_word, last_word, cover) for each span, and one of template -1 for each text.

    row numbers the input rows. A base span is a place where all words of a phrase stand consecutively. Another one merges the
    diagonals of a template that lie at most GAP apart; cover is the share of the template's k-grams that stand
    in it in order, less the words added or left out between them.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = template_rows(phrases, templates)
    known = docs.sparkSession.createDataFrame(rows, "template int, base boolean, label string, n_grams int, place int, gram long")
    if len(rows) <= BROADCAST_GRAMS:
        known = F.broadcast(known)
    grams = texts.mapInArrow(_grams, "row long, doc_id long, n_words int, position int, gram long")
    met = grams.join(known, "gram").where("(position < 0) = (template < 0)")
    key = ["row", "doc_id", "n_words", "template", "base", "label", "n_grams"]
    votes = met.groupBy(*key, (F.col("position") - F.col("place")).alias("diagonal")).agg(
        F.countDistinct("place").alias("votes"), F.min("position").alias("low"), F.max("position").alias("high"), F.collect_set(F.shiftleft(F.col("position").cast("long"), 32) + F.col("place")).alias("pairs")
    )
    w = Window.partitionBy("row", "template").orderBy("diagonal")
    votes = votes.where("not base or votes = n_grams")
    begins = F.when(F.col("base") | F.lag("diagonal").over(w).isNull() | (F.col("diagonal") - F.lag("diagonal").over(w) > GAP), 1).otherwise(0)
    merged = votes.withColumn("begins", begins).withColumn("span", F.sum("begins").over(w))
    held = merged.groupBy(*key, "span").agg(F.min("low").alias("first_word"), (F.max("high") + K - 1).alias("last_word"), F.count("*").alias("diagonals"), F.flatten(F.collect_list("pairs")).alias("pairs"))
    alone = F.col("base") | (F.col("diagonals") == 1)  # in order already; a repeated gram of one phrase is another span
    cover = F.when(F.col("base"), 1.0).when(alone, F.size("pairs") / F.col("n_grams")).otherwise(in_order(F.when(~alone, F.col("pairs"))) / F.col("n_grams"))
    return held.select("row", "doc_id", "n_words", "template", "base", "label", "n_grams", F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"), cover.alias("cover"))


def aligned(pairs) -> float | None:
    """The most k-grams in the template's order, less the words added or left out between them; pairs are position << 32 | place."""
    if pairs is None:
        return None
    found = [(int(x) >> 32, int(x) & 0xFFFFFFFF) for x in sorted(pairs)]
    far = 2 * (max(place for _, place in found) + 1)  # what lies farther back costs more words than it can have matched
    best: list[float] = []
    for i, (at, place) in enumerate(found):
        most = 0.0
        for j in range(i - 1, -1, -1):
            before, there = found[j]
            if at - before > far:
                break
            if before < at and there < place:
                most = max(most, best[j] - abs((at - before) - (place - there)))
        best.append(most + 1)
    return max(best)


@F.pandas_udf(DoubleType())
def in_order(pairs: pd.Series) -> pd.Series:
    return pd.Series([aligned(x) for x in pairs], dtype="float64")


def best_spans(spans: list[dict]) -> list[str]:
    """Labels of the spans that no better one covers: half of a span's words or more within one of another label that holds more k-grams."""
    taken: dict[str, list[tuple[int, int]]] = {}  # of each label, in order and apart from one another
    for s in sorted(spans, key=lambda x: (-x["held"], x["first_word"], x["label"])):
        first, last = s["first_word"], s["last_word"]

        def touched(places: list[tuple[int, int]]) -> slice:
            at = bisect.bisect_left(places, first, key=lambda x: x[1])  # noqa: B023
            return slice(at, bisect.bisect_right(places, last, lo=at, key=lambda x: x[0]))  # noqa: B023

        covered = lambda places: max((min(last, b) - max(first, a) + 1 for a, b in places[touched(places)]), default=0)  # noqa: B023, E731
        if all(2 * covered(places) < last - first + 1 for label, places in taken.items() if label != s["label"]):
            own = taken.setdefault(s["label"], [])
            at = touched(own)
            own[at] = [(min([first, *(a for a, _ in own[at])]), max([last, *(b for _, b in own[at])]))]
    return sorted(taken)


@F.pandas_udf(ArrayType(StringType()))
def uncovered(spans: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else best_spans(list(x)) for x in spans])


def scan(docs: DataFrame, least_cover: float = LEAST_COVER, id_col: str = "doc_id", text_col: str = "text", **known) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of phrases, first_word and last_word are their smallest and largest start (null without
    any). labels adds those of templates of which a span holds least_cover or more, unless half of the span's words
    or more lie in a span of another label that holds more; score is the largest cover of any
    span, 1 for a phrase. A null or empty text has zeros and empty labels. Repeated rows and null ids are kept, other
    columns are ignored, and an empty table gives no rows.
    """
    found = spans(docs, id_col=id_col, text_col=text_col, **known)
    base, held = F.col("base"), (F.col("template") >= 0) & ~F.col("base") & (F.col("cover") >= least_cover)
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    passage = F.when(held, F.struct("label", "first_word", "last_word", (F.col("cover") * F.col("n_grams")).alias("held")))
    scanned = found.groupBy("row", "doc_id", F.col("n_words").cast("long").alias("n_words")).agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first_word"))).alias("first_word"), F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("base_set"), F.collect_list(passage).alias("passages"),
        F.round(F.max(F.when(F.col("template") >= 0, F.col("cover")).otherwise(0.0)), 6).alias("score"),
    )
    # a document's passages are as many as its words allow; those of one label need no comparison
    labels = F.transform("passages", lambda x: x["label"])
    several = F.size(F.array_distinct(labels)) > 1
    labelled = scanned.withColumn("more", F.coalesce(uncovered(F.when(several, F.col("passages"))), labels))
    return labelled.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base_set")).alias("base_labels"), joined(F.array_union("base_set", "more")).alias("labels"), "score")
