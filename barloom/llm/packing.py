"""Best-fit packing of token sequences after dominance reduction, on the histogram of piece lengths.

What a packing looks like depends only on how many pieces have each length, and there are at most `capacity` lengths.
So the corpus is tokenised and counted in Spark, the plan (bins of like content, with multiplicities) is made from
the histogram, whose size has nothing to do with the input, and every piece finds its place by a join of its length
and its number among the pieces of that length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm._common import materialize

CAPACITY = 2048
#: Pieces of one length that one task numbers, about.
NUMBERED_ROWS = 200_000
#: Texts that a worker holds as objects at a time.
SLICE = 200
#: Texts with a run so long, of white space or of anything else, go to the slower library, which bears any.
LONG_RUN = 2_000

_loaded: dict[str, Encoder] = {}


def _octets() -> dict[str, int]:
    """The letters in which byte-level vocabularies write the bytes: printable ones are themselves, others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a tokenizers file.

    If the file is a byte-level BPE without normaliser whose ids are the ranks of its merges, ordinary texts are encoded
    by the same merges in a faster library. Texts with an added token or a very long run in them, texts that the faster
    one fails on, and all texts of other files go to the tokenizers library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.fast = None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        # tried where a run begins alone, so a text is gone over once
        self.long = re.compile(rf"(?<!\s)\s{{{LONG_RUN}}}|(?<!\S)\S{{{LONG_RUN}}}")
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges") or []]
        ranks = {t: i for t, i in model["vocab"].items() if t not in self.added}
        plain = not spec.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not model.get("dropout")
        if model.get("type") == "BPE" and plain and merges and all(ranks.get(a + b) == len(ranks) - len(merges) + i for i, (a, b) in enumerate(merges)):
            import tiktoken

            octets = _octets()
            own = {bytes(octets[c] for c in t): i for t, i in ranks.items()}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast and not self.long.search(text) and not any(t in text for t in self.added):
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as e:  # a panic of the faster library is no Exception
                if type(e).__name__ != "PanicException" and not isinstance(e, ValueError):
                    raise
        return self.whole.encode(text, add_special_tokens=False).ids


def encode(text: str | None, path: str) -> np.ndarray:
    """The text's ids, then id 0, as little-endian unsigned 32-bit numbers."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return np.array([*(_loaded[path].ids(text) if text else ()), 0], "<u4")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: all are full but the first, which is what remains."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, SLICE) for whole in batches for i in range(0, len(whole), SLICE)):
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = encode(text, path)
                out += [(doc_id, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(cut(len(ids), capacity))]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def reduce_by_dominance(counts: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins that an optimal packing may hold, as (lengths, how many); takes their pieces out of counts.

    Tried from the longest length down, as long as any rule holds (each fixes a set that dominates every other one
    that could hold the piece):
    - nothing left fits beside it: it has a bin alone;
    - a single piece fills the bin exactly: the two go together;
    - at most one piece can be added (the two shortest do not fit together): the longest that fits is added;
    - the longest single addition is as long as any pair of additions can be: it is added.
    """
    fixed = []
    lengths = sorted(counts, reverse=True)
    for x in lengths:
        while counts[x] > 0:
            room = capacity - x
            have = counts.copy()
            have[x] -= 1
            small = sorted(y for y in have if have[y] > 0 and y <= room)
            if not small:
                if x == capacity or not any(counts[y] and y <= room for y in counts):
                    fixed.append(((x,), counts[x]))
                    counts[x] = 0
                else:  # only itself would fit, and there is one left
                    fixed.append(((x,), 1))
                    counts[x] -= 1
                continue
            best, least = small[-1], small[0]
            second = least if have[least] > 1 else (small[1] if len(small) > 1 else None)
            pair = None if second is None or least + second > room else room
            if pair is not None and best < room:
                # the most that two additions can come to
                i, j, pair = 0, len(small) - 1, 0
                while i <= j:
                    s = small[i] + small[j]
                    if s > room:
                        j -= 1
                    elif i == j and have[small[i]] < 2:
                        break
                    else:
                        pair = max(pair, s)
                        i += 1
                three = 3 * least <= room
                if pair > best or three:
                    break
            n = min(counts[x], counts[best]) if best != x else counts[x] // 2
            fixed.append(((x, best), n))
            counts[x] -= n
            counts[best] -= n
    return fixed


def best_fit(counts: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing; bins of like content are kept together, so the work is by lengths and not by pieces."""
    groups: dict[int, list[list]] = {}  # room left -> [lengths, bins]
    for x in sorted((y for y in counts if counts[y] > 0), reverse=True):
        left = counts[x]
        for room in sorted(r for r in groups if r >= x):
            while left and groups.get(room):
                lengths, bins = groups[room].pop()
                each = min(room // x, left)
                n = min(bins, left // each)
                groups.setdefault(room - each * x, []).append([lengths + (x,) * each, n])
                left -= n * each
                if bins > n:
                    groups[room].append([lengths, bins - n])
            if not left:
                break
        if left:
            each = capacity // x
            if left // each:
                groups.setdefault(capacity - each * x, []).append([(x,) * each, left // each])
            if left % each:
                groups.setdefault(capacity - left % each * x, []).append([(x,) * (left % each), 1])
    return [(tuple(lengths), n) for found in groups.values() for lengths, n in found]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first number, end number, first sequence, how many in each sequence, first offset) of each slot."""
    rest = Counter(counts)
    bins = reduce_by_dominance(rest, capacity)
    bins += best_fit(rest, capacity)
    slots, used, sequence = [], Counter(), 0
    for lengths, n in bins:
        offset = 0
        for x, each in Counter(lengths).items():
            slots.append((x, used[x], used[x] + n * each, sequence, each, offset))
            used[x] += n * each
            offset += x * each
        sequence += n
    return slots


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and id 0 (a null text: id 0 alone). Longer ones than capacity are cut from their end into
    full pieces; the first may be shorter. Rows that repeat are packed as often as they occur; a null id is kept.
    Other columns are ignored, and an empty table gives no rows. tokenizer: path of a tokenizers file.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialize(texts.mapInArrow(_pieces(path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"))

    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots = docs.sparkSession.createDataFrame(plan(counts, capacity), "length long, low long, high long, first long, each long, at long")

    # numbers within a length: within shares of it, each counted on from the shares before
    shares = max(1, -(-sum(counts.values()) // NUMBERED_ROWS))
    pieces = pieces.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shares)))
    sizes = pieces.groupBy("length", "share").agg(F.count("*").alias("n"))
    before = sizes.select("length", "share", (F.sum("n").over(Window.partitionBy("length").orderBy("share")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32")) - 1
    numbered = pieces.withColumn("own", own).join(before, ["length", "share"]).withColumn("number", F.col("own") + F.col("before"))
    # slots are bounded by the capacity: a few for each length
    placed = numbered.join(F.broadcast(slots), "length").where("number >= low and number < high")
    inside = F.col("number") - F.col("low")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.expr("(number - low) div each")).alias("sequence_id"), (F.col("at") + inside % F.col("each") * F.col("length")).alias("offset"),
    )
