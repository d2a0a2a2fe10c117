"""Ranked lexical search by a document FP-tree.

A document is reduced to the terms that any item asks for, in the order of their document frequency, most frequent
first. Documents that begin alike share a path of a prefix tree, whose nodes hold the largest tf of each term and the
smallest length norm m below them. As a term's score grows with tf and shrinks with m, both bound the score of every
document below; each item goes down the tree depth first, best bound first, and leaves out what cannot reach its list.

Trees are of bounded size: a task builds one after another over its documents and carries each item's list along, so
later trees are pruned by what earlier ones gave. Lists of tasks meet in two windowed selections.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm._common import materialize, small_batches

#: A term's bytes (0-9, A-Z, a-z and all of non-ASCII characters; A-Z lower-cased); all others stand for a space.
TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Bytes of a text whose words are objects at a time.
WINDOW = 1_000_000
#: Characters of the items that are asked in one pass over the documents: bounds the vocabulary that tasks hold.
ITEM_CHARS = 2_000_000
#: Numbers in the table of a tree's documents (documents times terms), and documents below which a node is a leaf.
TREE_CELLS, LEAF = 8_000_000, 12


def term_counts(text: bytes) -> tuple[int, Counter]:
    """Number of terms of a text and how often each occurs; a window of the text at a time, cut between terms."""
    low, at, n, found = text.translate(TERMS), 0, 0, Counter()
    while at < len(low):
        end = low.find(b" ", at + WINDOW)
        end = len(low) if end < 0 else end
        words = low[at:end].split()
        n += len(words)
        found.update(words)
        at = end
    return n, found


def _vectors(known: dict[bytes, int]):
    """Of each document with terms: doc_id, its number of terms, which of the known terms it has, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lengths, terms, tfs = [], [], [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
                n, found = term_counts(text.as_py() or b"")
                if n:
                    had = {known[t]: tf for t, tf in found.items() if t in known}
                    ids.append(doc_id)
                    lengths.append(n)
                    terms.append(list(had))
                    tfs.append(list(had.values()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    return run


def _gained(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Scores of rows of tf (a column for each weight) under length norms m."""
    return ((1_000_000_000 * tf) // (1000 * tf + 12 * m[:, None])) @ weight


@dataclass
class Item:
    """Its terms' ranks and weights (repeats added up), and its best documents so far: a heap of (score, has an id, -id)."""

    ranks: np.ndarray
    weights: np.ndarray
    best: list


class Tree:
    """A compressed prefix tree over documents' rank vectors (in ascending rank: most frequent first).

    profiles: {(ranks, tfs, m): ids}; documents that agree in all of it are one. Nodes are numbered so that the children
    of one follow each other; node i has rows low[i] to high[i], children first[i] to last[i] (none: a leaf), the largest
    tf of each term in tops[i], and the smallest m in least[i].
    """

    def __init__(self, profiles: dict[tuple[bytes, bytes, int], list], terms: int):
        rows = sorted(((np.frombuffer(r, ">u4"), np.frombuffer(t, "i8"), m, ids) for (r, t, m), ids in profiles.items()), key=lambda x: (x[0].tobytes(), x[1].tobytes(), x[2]))
        self.ids = [r[3] for r in rows]
        self.m = np.array([r[2] for r in rows], "i8")
        self.tf = np.zeros((len(rows), terms), "i8" if any(len(r[1]) and r[1].max() >= 2**32 for r in rows) else "u4")
        for i, (ranks, tfs, _, _) in enumerate(rows):
            self.tf[i, ranks] = tfs
        self._grow([r[0].tolist() for r in rows])

    def _grow(self, paths: list[list[int]]) -> None:
        self.low, self.high, self.first, self.last = [0], [len(paths)], [0], [0]
        depths, node = [0], 0
        while node < len(self.low):
            low, high, depth = self.low[node], self.high[node], depths[node]
            if high - low > LEAF:
                a, b = paths[low], paths[high - 1]  # they are in order: what these two share, all share
                while depth < min(len(a), len(b)) and a[depth] == b[depth]:
                    depth += 1
                following = [p[depth] if len(p) > depth else -1 for p in paths[low:high]]
                cuts = [low, *(low + i for i in range(1, high - low) if following[i] != following[i - 1]), high]
                if len(cuts) > 2:
                    self.first[node], self.last[node] = len(self.low), len(self.low) + len(cuts) - 1
                    self.low += cuts[:-1]
                    self.high += cuts[1:]
                    self.first += [0] * (len(cuts) - 1)
                    self.last += [0] * (len(cuts) - 1)
                    depths += [depth + 1] * (len(cuts) - 1)
            node += 1
        self.tops = np.zeros((len(self.low), self.tf.shape[1]), self.tf.dtype)
        self.least = np.zeros(len(self.low), "i8")
        for i in reversed(range(len(self.low))):  # children come after their parents
            below, at = ((self.tops, slice(self.first[i], self.last[i])), self.least) if self.last[i] else ((self.tf, slice(self.low[i], self.high[i])), self.m)
            table, span = below
            self.tops[i] = table[span].max(axis=0)
            self.least[i] = at[span].min()

    def search(self, item: Item, k: int) -> None:
        """Puts into the item's heap what of this tree is among its k best; equal scores by ascending id, rows without id last."""
        best = item.best
        open_nodes = [(None, 0)]
        while open_nodes:
            bound, node = open_nodes.pop()
            if bound is not None and len(best) == k and bound < best[0][0]:
                continue
            if not self.last[node]:
                span = slice(self.low[node], self.high[node])
                scores = _gained(item.weights, self.tf[span, item.ranks].astype("i8"), self.m[span])
                for i in np.flatnonzero(scores >= max(1, best[0][0] if len(best) == k else 1)):
                    for doc_id in self.ids[span.start + i]:
                        entry = (int(scores[i]), doc_id is not None, -(doc_id or 0))
                        if len(best) < k:
                            heapq.heappush(best, entry)
                        elif entry > best[0]:
                            heapq.heapreplace(best, entry)
                continue
            span = slice(self.first[node], self.last[node])
            bounds = _gained(item.weights, self.tops[span, item.ranks].astype("i8"), self.least[span])
            least = max(1, best[0][0] if len(best) == k else 1)
            for i in np.argsort(bounds, kind="stable"):  # the best is taken next
                if bounds[i] >= least:
                    open_nodes.append((int(bounds[i]), span.start + int(i)))


def _ranked(items: list[tuple[int | None, list[int]]], rank: np.ndarray, weight: np.ndarray, n_docs: int, all_terms: int, k: int, cells: int):
    """Each item's k best documents of a task. items: (item_id, terms, repeats included); rank and weight by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = []
        for item_id, terms in items:
            times = Counter(terms)
            own = np.array([t for t in times if weight[t] > 0], int)
            asked.append((item_id, Item(rank[own], np.array([weight[t] * times[t] for t in own.tolist()], "i8"), [])))
        profiles: dict[tuple[bytes, bytes, int], list] = {}

        def flush() -> None:
            if profiles:
                tree = Tree(profiles, len(rank))
                for _, item in asked:
                    if len(item.ranks):
                        tree.search(item, k)
                profiles.clear()

        for b in batches:
            terms, tfs = b.column("terms"), b.column("tfs")
            ends, flat, flat_tf = terms.offsets.to_numpy(), terms.values.to_numpy(), tfs.values.to_numpy()
            for i, (doc_id, n) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(), strict=True)):
                ranks = rank[flat[ends[i] : ends[i + 1]]]
                order = np.argsort(ranks)
                key = ranks[order].astype(">u4").tobytes(), flat_tf[ends[i] : ends[i + 1]][order].astype("i8").tobytes(), 75 + (25 * n * n_docs) // all_terms
                ids = profiles.setdefault(key, [])
                ids.append(doc_id)
                if len(ids) > 4 * k:  # no list holds more than the k smallest of documents that score alike
                    ids[:] = heapq.nsmallest(k, ids, key=lambda x: (x is None, x or 0))
                if len(profiles) * max(1, len(rank)) >= cells:
                    flush()
        flush()
        found = [(j, item_id, -entry[2] if entry[1] else None, entry[0]) for j, (item_id, item) in enumerate(asked) for entry in item.best]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["item", "item_id", "doc_id", "score"])

    return run


def _search_block(docs: DataFrame, items: list[tuple[int | None, list[bytes]]], block: int, k: int, cells: int) -> DataFrame:
    words = sorted({w for _, ws in items for w in ws})
    known = {w: i for i, w in enumerate(words)}
    with small_batches(docs.sparkSession):
        vectors = materialize(docs.mapInArrow(_vectors(known), "doc_id long, n long, terms array<int>, tfs array<long>"))
    n_docs, all_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(words), "i8")
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], "i8")
    rank = np.empty(len(words), "i8")
    rank[np.argsort(-df, kind="stable")] = np.arange(len(words))
    run = _ranked([(i, [known[w] for w in ws]) for i, ws in items], rank, weight, n_docs, all_terms, k, cells)
    found = vectors.mapInArrow(run, "item int, item_id long, doc_id long, score long")
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    # lists of many tasks are thinned out in parts before an item's meet
    found = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(32))).withColumn("rank", first("item", "part")).where(F.col("rank") <= k)
    return found.withColumn("rank", first("item")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, item_chars: int = ITEM_CHARS, cells: int = TREE_CELLS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best docs (doc_id, text) for each row of items (item_id, text).

    Terms are the maximal matches of [^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+ in the whole text, A-Z lower-cased;
    null has none. With N documents that have terms, L terms in all of them, n in one, df documents that hold a term, a
    term's weight is w = floor(1000 ln((2N+2) / (2df+1))), a document's norm m = 75 + (25 n N) div L, and its score the sum
    of w * ((1000000000 tf) div (1000 tf + 12 m)) over the item's terms, repeats included. Scores of 0 are left out, equal
    scores stand by ascending doc_id (null last). Rows that repeat are documents and items of their own. Further columns
    are left out; without documents, items or common terms there are no rows. Items are asked in blocks of about
    item_chars characters, one pass over the documents each; what tasks and the driver hold is bounded by a block.
    """
    docs, items = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), materialize(items.select(F.col("item_id").cast("long").alias("item_id"), "text").withColumn("row", F.monotonically_increasing_id()))
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(chars / item_chars))
    found = []
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).orderBy("item_id", "row").collect()
        asked = [(r["item_id"], [w for w, times in term_counts((r["text"] or "").encode())[1].items() for _ in range(times)]) for r in rows]
        found.append(_search_block(docs, asked, block, k, cells))
    return reduce(DataFrame.unionByName, found)
