"""Exact self join of documents by the Jaccard similarity of their word n-gram sets, over prefix trees.

The plan:

1. One pass over the texts gives each document the size of its n-gram set and the n-grams of a fixed share of the
   hash space ("sampled" n-grams; the share only decides how soon a document can be ruled out, never the result).
2. Global n-gram order: sampled n-grams by document frequency, rarest first, then all others by hash. Two sets of
   similarity t share an n-gram within their first n - ceil(t n) + 1; a document whose first ones are all its own can
   be linked with nothing and leaves here. Frequencies come from a counted, map-side combined aggregation.
3. Documents that share a prefix n-gram fall into one candidate component. A component is dealt to tasks whole if it
   is small, and otherwise by set size and salt into chunks of bounded size: no component, however large, has to fit in
   one task, and none is cut short. To count links, all pairs of chunks near enough in size meet. For components alone,
   each chunk first meets itself and a few members of the component; then only documents that this leaves outside the
   component's largest group meet one another, and those of that group that share a prefix n-gram with them.
4. In a task the sets are stored in a path-compressed trie. It is walked once for all probing sets together: the
   overlaps along a shared path are counted once, and a probe leaves a subtree as soon as the most that the
   remaining lengths allow is below what the threshold asks.
5. Tasks return, for each document, a local root and its number of links; components of those edges are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm._common import bitmap_hit, bitmap_prefilter, connected_components, free_name, materialize, release, worker_cache

#: N-grams that one side of a task holds at most, but for single documents that are larger.
CHUNK_NGRAMS = 500_000
#: Words whose hashes a worker remembers, and texts that it holds as objects at a time.
CACHED_WORDS, SLICE = 250_000, 200
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def ngram_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles (A-Z lower-cased, words between ASCII white space).

    A text of 1 to k-1 words has its whole sequence as its one shingle; one without words has none. Two different
    shingles have the same hash with a probability of 2**-64.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = worker_cache("word hashes", _WordHashes)
    if len(hashes) > CACHED_WORDS:
        hashes.clear()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(k, len(h))
    mix = np.resize(_MIX, k)
    s = np.full(len(h) - size + 1, size * 0x9FB21C651E98DF25 % 2**64, np.uint64)
    for j in range(size):
        x = h[j : len(h) - size + 1 + j] ^ np.uint64(j * 0x2545F4914F6CDD1D % 2**64)
        x *= mix[j]
        x ^= x >> np.uint64(32)
        s = s * np.uint64(0xD1342543DE82EF95) + x
    s ^= s >> np.uint64(30)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(27)
    return np.unique(s)


def _prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)])))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, SLICE) for b in batches for i in range(0, len(b), SLICE))


def _signatures(k: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sizes, kept = [], []
            for text in b.column("text").to_pylist():
                s = ngram_set(text, k)
                sizes.append(len(s))
                kept.append(s[: np.searchsorted(s, np.uint64(limit))].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), b.column("key2"), pa.array(sizes, pa.int64()), _lists(kept)], names=["doc_id", "key", "key2", "n", "grams"])

    return run


def _prefixes(k: int, limit: int, num: int, den: int):
    """The set of each remaining document, and those of its prefix n-grams that others have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            prefixes, sets = [], []
            shared = b.column("shared")
            lengths = shared.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends, pairs = np.cumsum(lengths), shared.flatten()
            df, gram = (pairs.field(c).to_numpy(zero_copy_only=False) for c in ("df", "gram"))
            for text, own, end, length in zip(b.column("text").to_pylist(), b.column("own").to_pylist(), ends, lengths, strict=True):
                s = ngram_set(text, k).view(np.int64)
                size = _prefix_length(len(s), num, den)
                d, g = df[end - length : end], gram[end - length : end]
                prefix = g[np.lexsort((g, d))][: max(0, size - own)]
                if (rest := size - own - len(prefix)) > 0:
                    start = np.searchsorted(s.view(np.uint64), np.uint64(limit))
                    prefix = np.concatenate([prefix, s[start : start + rest]])
                prefixes.append(prefix)
                sets.append(s)
            yield pa.RecordBatch.from_arrays([b.column("cls"), b.column("copies"), b.column("n"), _lists(prefixes), _lists(sets)], names=["cls", "copies", "n", "prefix", "grams"])

    return run


def trie_links(trie: list[np.ndarray], probes: list[np.ndarray], num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, indexes of the probes linked with trie[i]) for each trie set; sets are sorted arrays of distinct values.

    Linked: den * |intersection| >= num * |union|. A probe that is the set itself is linked with it.
    """
    values, inverse, counts = np.unique(np.concatenate([*trie, *probes]), return_inverse=True, return_counts=True)
    # most frequent first within the task: near copies then share long paths
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(values))
    flat = rank[inverse]
    bounds = np.cumsum([0, *map(len, trie), *map(len, probes)])
    sets = [np.sort(flat[bounds[i] : bounds[i + 1]]) for i in range(len(trie) + len(probes))]
    order = sorted(range(len(trie)), key=lambda i: sets[i].astype(">u4").tobytes())
    paths = [sets[i] for i in order]
    size = np.array([len(p) for p in paths])
    probe_sets = sets[len(trie) :]
    m = np.array([len(p) for p in probe_sets])
    v = len(values) + 1
    # (probe, rank) pairs in order, to count a probe's n-grams up to a rank; and the probes of each n-gram
    keys = np.concatenate([p + q * v for q, p in enumerate(probe_sets)])
    first = np.concatenate([[0], np.cumsum(m)])[:-1]
    ranks, owners = np.concatenate(probe_sets), np.repeat(np.arange(len(m)), m)
    by = np.argsort(ranks, kind="stable")
    owners, starts = owners[by], np.searchsorted(ranks[by], np.arange(v))

    def lcp(x: np.ndarray, y: np.ndarray) -> int:
        k = min(len(x), len(y))
        differ = np.flatnonzero(x[:k] != y[:k])
        return int(differ[0]) if len(differ) else k

    common = [lcp(paths[i], paths[i + 1]) for i in range(len(paths) - 1)]
    stack = [(0, 0, len(paths), np.zeros(len(m), np.int64), np.arange(len(m)))]
    while stack:
        depth, lo, hi, overlap, active = stack.pop()
        # children: runs of paths that stay together below this depth
        at = lo
        while at < hi:
            end = at + 1
            while end < hi and common[end - 1] > depth:
                end += 1
            deep = int(size[at]) if end == at + 1 else min(common[at : end - 1])
            edge = paths[at][depth:deep]
            gained, live = overlap, active
            if len(edge):
                reach = starts[edge + 1] - starts[edge]
                where = np.repeat(starts[edge] - np.concatenate([[0], np.cumsum(reach)[:-1]]), reach) + np.arange(reach.sum())
                gained = overlap + np.bincount(owners[where], minlength=len(m))
                passed = np.searchsorted(keys, live * v + edge[-1] + 1) - first[live]
                most = gained[live] + np.minimum(size[at:end].max() - deep, m[live] - passed)
                live = live[(den + num) * most >= num * (m[live] + size[at:end].min())]
            if end == at + 1:
                o = gained[live]
                yield order[at], live[den * o >= num * (m[live] + size[at] - o)]
            elif len(live):
                stack.append((deep, at, end, gained, live))
            else:
                for i in range(at, end):
                    yield order[i], live
            at = end


def _link_groups(num: int, den: int):
    def component(rows: list[tuple]) -> Iterator[tuple[int, int, int]]:
        """rows: (cls, copies, side, set); side 1 meets side 2, side 0 meets itself."""
        left, right = [r for r in rows if r[2] != 2], [r for r in rows if r[2] != 1]
        if not left or not right:
            return
        same = left[0][2] == 0
        weight_l, weight_r = (np.array([r[1] for r in side]) for side in (left, right))
        links_l, links_r = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
        label = np.arange(len(left) + (0 if same else len(right)))
        shift = 0 if same else len(left)
        for i, found in trie_links([r[3] for r in left], [r[3] for r in right], num, den):
            if same:
                found = found[found != i]
            links_l[i] += weight_r[found].sum()
            if not same:
                links_r[found] += weight_l[i]
            joined = np.unique(np.append(label[found + shift], label[i]))
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
        nodes = [r[0] for r in left] + ([] if same else [r[0] for r in right])
        links = np.concatenate([links_l, links_r]) if not same else links_l
        for x, root, n in zip(nodes, label, links, strict=True):
            if n:
                yield x, nodes[root], int(n)

    def run(table: pa.Table) -> pa.Table:
        groups: dict[int, list[tuple]] = {}
        flat = table.column("grams").combine_chunks()
        values, offsets = flat.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(flat.value_lengths().to_numpy())])
        for i, (task, cls, copies, side) in enumerate(zip(*(table.column(c).to_pylist() for c in ("task", "cls", "copies", "side")), strict=True)):
            groups.setdefault(task, []).append((cls, copies, side, values[offsets[i] : offsets[i + 1]]))
        found = [x for rows in groups.values() if len(rows) > 1 for x in component(rows)]
        return pa.table({c: pa.array([x[j] for x in found], pa.int64()) for j, c in enumerate(("cls", "root", "links"))})

    return run


def _pairs_of_chunks(members: DataFrame, chunk_ngrams: int) -> DataFrame:
    """(task, cls, copies, side) of members (component, part, band, cls, copies, n): chunks of bounded size, each pair of
    which meets in a task if their bands are the same or neighbours and not both are of part 1."""
    key = ["component", "part", "band"]
    salts = members.groupBy(*key).agg((F.floor(F.sum("n") / chunk_ngrams) + 1).alias("salts"))
    chunks = salts.select(*key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    other = chunks.withColumnsRenamed({"part": "part2", "band": "band2", "salt": "salt2"})
    pairs = (
        chunks.withColumn("band2", F.explode(F.array("band", F.col("band") + 1))).join(other, ["component", "band2"])
        .where("(band2 > band or part2 > part or (part2 = part and salt2 >= salt)) and part + part2 < 2")
        .withColumn("task", F.xxhash64("component", "part", "band", "salt", "part2", "band2", "salt2"))
    )
    dealt = members.join(salts, key).withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("salts")))
    itself = F.expr("band = band2 and part = part2 and salt = salt2")
    row = lambda side: ("task", "cls", "copies", side.alias("side"))
    one = dealt.join(pairs, [*key, "salt"]).select(*row(F.when(itself, 0).otherwise(1)))
    second = dealt.withColumnsRenamed({"part": "part2", "band": "band2", "salt": "salt2"})
    two = second.join(pairs.where(~itself), ["component", "part2", "band2", "salt2"]).select(*row(F.lit(2)))
    return one.union(two)


def _chunks_with_heads(members: DataFrame, chunk_ngrams: int, heads: int = 8) -> DataFrame:
    """(task, cls, copies, side) of members: each chunk of bounded size by itself, joined by a few members of its component."""
    salts = members.groupBy("component", "band").agg((F.floor(F.sum("n") / chunk_ngrams) + 1).alias("salts"))
    dealt = members.join(salts, ["component", "band"]).select(F.xxhash64("component", "band", F.pmod(F.xxhash64("cls"), F.col("salts"))).alias("task"), "component", "cls", "copies")
    which = F.pmod(F.xxhash64("cls", F.lit(7)), F.lit(heads)).alias("which")
    chosen = members.groupBy("component", which).agg(F.min(F.struct("cls", "copies")).alias("h")).select("component", "h.cls", "h.copies")
    guests = dealt.select("component", "task").distinct().join(chosen, "component")
    return dealt.select("task", "cls", "copies", F.lit(0).alias("side")).union(guests.select("task", "cls", "copies", F.lit(0)))


def _classes(docs: DataFrame, k: int, threshold: tuple[int, int], id_col: str, text_col: str, chunk_ngrams: int, count_links: bool) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows (doc_id, key, key2, n), one per input row; classes (key, key2, n, node, copies, low, links), one per text.

    node is a text's smallest id, low that of its component. Without count_links, links is null.
    """
    num, den = threshold
    # enough n-grams that a document's own ones among them outnumber its prefix; longer n-grams are more often its own
    share = min(1.0, (2.5 if k < 5 else 1.75) * (den - num) / den)
    limit = min(2**63, int(2**64 * share / 2)) * 2 - 1
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = texts.withColumns({"key": F.xxhash64("text"), "key2": F.xxhash64(F.lit(1), "text")})
    signed = materialize(keyed.mapInArrow(_signatures(k, limit), "doc_id long, key long, key2 long, n long, grams array<long>"))

    classes = signed.groupBy("key", "key2", "n").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()))  # numbers that last, as they are written

    # document frequency of sampled n-grams; an n-gram that only one class has occurs as often as the class has copies
    occurs = signed.where("n > 0").select("key", F.explode("grams").alias("gram"))
    frequency = occurs.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    shared = occurs.join(frequency, "gram").groupBy("key", "gram").agg(F.max("df").alias("df"))
    shared = shared.groupBy("key").agg(F.collect_list(F.struct("df", "gram")).alias("shared"))
    sampled = signed.groupBy("key", "key2").agg(F.max(F.size("grams")).alias("sampled"))
    prefix = F.col("n") - F.ceil(F.col("n") * num / den) + 1  # only decides who leaves early; +1 below covers rounding
    pick = lambda c: F.coalesce(c, F.lit(-(2**63)))
    left = materialize(
        classes.where("n > 0").join(sampled, ["key", "key2"]).join(shared, "key", "left")
        .withColumn("shared", F.filter("shared", lambda x: x["df"] > F.col("copies")))
        .withColumn("own", F.col("sampled") - F.coalesce(F.size("shared"), F.lit(0)))
        .where(F.col("own") < prefix + 1).select("key", "key2", pick("node").alias("pick"), "cls", "copies", "n", "own", "shared")
    )
    rows = materialize(signed.select("doc_id", "key", "key2", "n"))
    release(signed)
    # few documents are left: their texts are picked out before they are shuffled
    sets = left.join(
        bitmap_prefilter(keyed.select("key", "key2", pick("doc_id").alias("pick"), "text"), "key", left.select("key")),
        ["key", "key2", "pick"],
    ).dropDuplicates(["key", "key2"])
    sets = materialize(
        sets.select("cls", "copies", "n", F.col("own").cast("long").alias("own"), "shared", "text").mapInArrow(
            _prefixes(k, limit, num, den), "cls long, copies long, n long, prefix array<long>, grams array<long>"
        )
    )
    release(left)

    # candidate components: documents that share a prefix n-gram, by way of the smallest of them
    spread = sets.select("cls", F.explode("prefix").alias("gram"))
    heads = spread.groupBy("gram").agg(F.min("cls").alias("head"), F.count("*").alias("c")).where("c > 1")
    candidates = connected_components(spread.join(heads, "gram").select(F.col("cls").alias("a"), F.col("head").alias("b")))

    # tasks are dealt by numbers and sizes alone; the sets join them once
    placed = materialize(candidates.select(F.col("node").alias("cls"), "component").join(sets.select("cls", "copies", "n"), "cls"))
    weights = materialize(placed.groupBy("component").agg(F.sum("n").alias("total")))
    total = weights.agg(F.sum("total")).first()[0] or 0
    bins = max(1, -(-total // chunk_ngrams)) * 4
    step = float(np.log(den / num) * 1.0001)
    large = weights.where(F.col("total") > chunk_ngrams).select("component")
    small = placed.join(large, "component", "left_anti").select(
        F.pmod(F.xxhash64("component"), F.lit(bins)).alias("deal"), F.col("component").alias("task"), "cls", "copies", F.lit(0).alias("side")
    )
    members = placed.join(large, "component").withColumns({"band": F.floor(F.log(F.col("n").cast("double")) / step), "part": F.lit(0)})
    deal = lambda tasks: tasks.select(F.col("task").alias("deal"), "task", "cls", "copies", "side")

    def linked(tasks: DataFrame) -> DataFrame:
        given = tasks.join(sets.select("cls", "grams"), "cls")
        return materialize(given.groupBy("deal").applyInArrow(_link_groups(num, den), "cls long, root long, links long"))

    if count_links:
        links = linked(small.union(deal(_pairs_of_chunks(members, chunk_ngrams))))
    else:
        # most of a large group is joined by a few of its own; only what is not is compared with the rest
        links = linked(small.union(deal(_chunks_with_heads(members, chunk_ngrams))))
        if not large.isEmpty():
            so_far = connected_components(links.select(F.col("cls").alias("a"), F.col("root").alias("b")))
            now = materialize(members.join(so_far.select(F.col("node").alias("cls"), F.col("component").alias("found")), "cls", "left").withColumn("found", F.coalesce("found", "cls")))
            parts = now.groupBy("component", "found").agg(F.sum("n").alias("size"))
            main = parts.groupBy("component").agg(F.max(F.struct("size", "found"))["found"].alias("main"), F.count("*").alias("c")).where("c > 1")
            split = materialize(now.join(main, "component").withColumn("part", (F.col("found") == F.col("main")).cast("int")))
            # of the main part only those that share a prefix n-gram with one of the others
            grams = split.where("part = 0").select("cls").join(spread, "cls").select("gram").distinct()
            near = spread.join(grams, "gram", "left_semi").select("cls").distinct()
            rest = split.where("part = 0").unionByName(split.where("part = 1").join(near, "cls", "left_semi"))
            links = links.union(linked(deal(_pairs_of_chunks(materialize(rest.select("component", "part", "band", "cls", "copies", "n")), chunk_ngrams))))

    # rows that repeat an id with other texts are one document
    ids = rows.where("doc_id is not null and n > 0").groupBy("doc_id").agg(*(f("key").alias(f"{f.__name__}1") for f in (F.min, F.max)), *(f("key2").alias(f"{f.__name__}2") for f in (F.min, F.max)))
    several = materialize(ids.where("min1 <> max1 or min2 <> max2").select("doc_id"))
    named = bitmap_prefilter(rows.select("doc_id", "key", "key2"), "doc_id", several).join(several, "doc_id", "left_semi").distinct().join(classes.select("key", "key2", "cls"), ["key", "key2"])
    same = named.join(named.groupBy("doc_id").agg(F.min("cls").alias("b")), "doc_id").select(F.col("cls").alias("a"), "b")

    roots = connected_components(links.select(F.col("cls").alias("a"), F.col("root").alias("b")).union(same)).select(F.col("node").alias("cls"), "component")
    linked_up = materialize(classes.join(roots, "cls").select("cls", "component", "node"))
    low = linked_up.join(linked_up.groupBy("component").agg(F.min("node").alias("low")), "component").select("cls", "low", F.lit(True).alias("grouped"))
    degrees = links.groupBy("cls").agg(F.sum("links").alias("links"))
    if not count_links:
        degrees = degrees.withColumn("links", F.lit(None).cast("long"))
    result = classes.join(low, "cls", "left").join(degrees, "cls", "left").select(
        "key", "key2", "n", "node", "copies", F.when(F.col("grouped"), F.col("low")).otherwise(F.col("node")).alias("low"), F.coalesce("grouped", F.lit(False)).alias("grouped"),
        F.coalesce("links", F.lit(0)).alias("links") if count_links else F.lit(None).cast("long").alias("links"),
    )
    release(sets, placed, weights)
    return rows, result


def ngram_jaccard_join(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text", chunk_ngrams: int = CHUNK_NGRAMS, count_links: bool = True) -> DataFrame:
    """One row per input row: (id, n_shingles, component_id, n_links).

    threshold (num, den): two documents link when den * |intersection| >= num * |union| of their k-word shingles.
    component_id is the smallest id reachable by links, the row's own included; n_links counts the other rows that a
    row links with, its exact copies too. Exact copies are joined once and share one result. With count_links=False
    n_links is null, and members of a large group that a few of its own already join are not compared with one another.

    A null or wordless text has no shingles, links with nothing and is its own component. Texts that share an id are
    one document, so their components are one. A row without id links like any other and lends its component no name;
    a component without any id has a null one. Other columns are ignored. An empty table gives an empty result.
    """
    rows, classes = _classes(docs, k, threshold, id_col, text_col, chunk_ngrams, count_links)
    empty = F.col("n") == 0
    # one class may hold a third of all rows: the classes' side has one row a key, so the other side can be split
    return rows.join(classes.select("key", "key2", "low", "links", "copies"), ["key", "key2"], "left").select(
        F.col("doc_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("low")).alias("component_id"),
        F.when(empty, F.lit(0)).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
    )


def keep_first(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text", chunk_ngrams: int = CHUNK_NGRAMS) -> DataFrame:
    """The rows of docs without near copies, with all their columns: of each group one row of the smallest id stays.

    Rows without id come after all others. Null and wordless texts stay. Only rows whose text has copies or links are
    shuffled with it.
    """
    _, classes = _classes(docs, k, threshold, id_col, text_col, chunk_ngrams, False)
    first = F.row_number().over(Window.partitionBy("low").orderBy("node", "key", "key2")) == 1
    judged = classes.where("n > 0 and (copies > 1 or grouped)")
    keepers = judged.where("low is not null and node = low").withColumn("stays", first).unionByName(judged.where("low is null or node is null or node <> low").withColumn("stays", F.col("low").isNull()))
    judged = materialize(keepers.select("key", "key2", "node", "stays"))
    key, key2, hit = (free_name(docs, c) for c in ("key", "key2", "hit"))
    text = F.col(text_col).cast("string")
    marked = bitmap_hit(docs.withColumns({key: F.xxhash64(text), key2: F.xxhash64(F.lit(1), text)}), key, judged.select(F.col("key").alias(key)), hit)
    d, j = marked.where(hit).alias("d"), judged.alias("j")
    met = d.join(j, (F.col(f"d.`{key}`") == F.col("j.key")) & (F.col(f"d.`{key2}`") == F.col("j.key2")), "left")
    own = F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("j.node"))
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    unjudged = met.where("j.stays is null").select(*columns)
    stay = met.where(F.col("j.stays") & own).select(*columns, F.col(f"d.`{key}`"), F.col(f"d.`{key2}`")).dropDuplicates([key, key2])
    return marked.where(~F.col(hit)).select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(unjudged).unionByName(stay.drop(key, key2))
