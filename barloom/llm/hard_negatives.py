"""Hard negatives by a secondary sort.

Anchors and rows are dealt to blocks of bounded size, and a task scores one block of anchors against one block of rows.
What leaves a task is already reduced without loss: per anchor the best positives of the block first, and then, once an
anchor's positives (and so its windows of scores) are known, the best negatives of the block in each window. Their
scores are keyed by (anchor, descending score, id), dealt by anchor and sorted within the partitions; one pass over that
stream opens an anchor's windows as its positives come by and emits the negatives that fall into them; it holds an anchor's
windows, never its rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.scratch import written

#: Rows and anchors of a block, about. A task holds two blocks, and scores a slice of SLICE anchors at a time.
ROWS, ANCHORS, SLICE = 8192, 4096, 256
#: Whole numbers up to here are exact in doubles.
EXACT = 2.0**53

#: What leaves a task that scored two blocks: the anchor's row and id, the score, the partner's id and row.
SCORED = pa.schema([(c, pa.int64()) for c in ("anchor", "anchor_id", "score", "id", "rid")])
MINED = pa.schema([(c, pa.int32() if c == "rank" else pa.int64()) for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")])


def _vectors(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """floor(256 * x) of each component as doubles, a row for each vector; shorter vectors end in zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype("f8"), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    out, lengths = np.zeros((len(lists), width)), np.diff(ends)
    out[np.arange(width) < lengths[:, None]] = np.floor(flat * 256.0)
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit numbers; ones that do not fit are an OverflowError."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < EXACT:
        return (a @ b.T).astype("i8")
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    return (whole(a) @ whole(b).T).astype("i8")


def _cell(places):
    """A cogrouped task: places(an anchor's scores, which are of its label, which is itself, anchors, its number) says which rows leave."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(anchors) or not len(rows):
            return SCORED.empty_table()
        rows = rows.sort_by([("vec_id", "ascending"), ("rid", "ascending")])
        width = max(max((len(x) for x in t.column("embedding")), default=0) for t in (anchors, rows)) or 1
        a, b = _vectors(anchors.column("embedding"), width), _vectors(rows.column("embedding"), width)
        label_a, label_b = anchors.column("label").to_numpy(), rows.column("label").to_numpy()
        rid_a, rid_b = anchors.column("rid").to_numpy(), rows.column("rid").to_numpy()
        who, where, what = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0, int)]
        for at in range(0, len(a), SLICE):
            for i, s in enumerate(_scores(a[at : at + SLICE], b), at):
                found = places(s, label_b == label_a[i], rid_b == rid_a[i], anchors, i)
                who.append(np.full(len(found), i))
                where.append(found)
                what.append(s[found])
        who, where = np.concatenate(who), np.concatenate(where)
        return pa.Table.from_arrays([anchors.column("rid").take(who), anchors.column("vec_id").take(who), pa.array(np.concatenate(what)), rows.column("vec_id").take(where), rows.column("rid").take(where)], schema=SCORED)

    return run


def _best(s: np.ndarray, among: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest scores among some places; of equal scores the first."""
    if len(among) > 4 * n:
        among = among[s[among] >= -np.partition(-s[among], n - 1)[n - 1]]
    return among[np.argsort(-s[among], kind="stable")[:n]]


def _positives(n: int):
    return _cell(lambda s, same, own, anchors, i: _best(s, np.flatnonzero(same & ~own), n))


def _bounds(p: int, low: int, high: int) -> tuple[int, int]:
    """The whole scores with low * p <= 100 * score <= high * p."""
    return -((-low * p) // 100), (high * p) // 100


def _negatives(n: int, low: int, high: int):
    def places(s, same, own, anchors, i):
        found = set()
        for p in set(anchors.column("positives")[i].as_py() or ()):
            least, most = _bounds(p, low, high)
            if least <= most:
                found.update(_best(s, np.flatnonzero(~same & (s >= least) & (s <= most)), n).tolist())
        return np.array(sorted(found), int)

    return _cell(places)


def _mined(n: int, low: int, high: int):
    """Over rows sorted by (anchor, descending score, positives first, id): each anchor's windows and what falls into them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, windows = None, []
        for b in batches:
            out = []
            for a, name, score, negative, partner in zip(*(b.column(c).to_pylist() for c in ("anchor", "anchor_id", "score", "negative", "id")), strict=True):
                if a != anchor:
                    anchor, windows = a, []
                if not negative:
                    windows.append([partner, score, *_bounds(score, low, high), 0])
                    continue
                for w in windows:
                    if w[2] <= score <= w[3]:
                        w[4] += 1
                        out.append((name, w[0], w[4], partner, w[1], score))
                windows = [w for w in windows if w[4] < n and w[2] <= score]  # full, or all that follows is below it
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t.type) for j, t in enumerate(MINED)], schema=MINED)

    return run


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, rows: int = ROWS, anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over vectors (vec_id, embedding, label).

    Anchors are the rows whose vec_id is divisible by `every`; scores are inner products of floor(256 * x); an anchor's
    positives are its first other rows of its label, and a positive's negatives the first rows of another label whose
    score is from low to high hundredths of its own. First is by descending score, then ascending vec_id. Rows with a null
    label, a null vector or a null or non-finite component take no part. A row without vec_id is no anchor, and comes
    last among equal scores. Each row stands for itself: one that repeats another is one more row, also as an anchor. A
    vector that is shorter than another counts as ended by zeros. A score beyond 64 bits is an OverflowError. Further
    columns are left out, and an empty table gives no rows.
    """
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    taking_part = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label")).where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~odd)
    known = written(taking_part.withColumn("rid", F.monotonically_increasing_id()))
    is_anchor = F.col("vec_id") % every == 0
    n, n_anchors = known.agg(F.count("*"), F.count_if(is_anchor)).first()
    across, down = max(1, math.ceil(n_anchors / anchors)), max(1, math.ceil(n / rows))
    numbers = lambda most: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long")))
    block = lambda most: F.pmod(F.xxhash64("rid"), F.lit(most).cast("long"))
    dealt = known.select("rid", "vec_id", "label", "embedding", block(down).alias("down"), numbers(across).alias("across")).groupBy("down", "across")
    asked = lambda found: found.withColumn("across", block(across)).withColumn("down", numbers(down)).groupBy("down", "across")

    wanted = known.where(is_anchor).toDF(*known.columns)
    first = asked(wanted).cogroup(dealt).applyInArrow(_positives(positives), "anchor long, anchor_id long, score long, id long, rid long")
    best = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("id"), "rid"))
    first = written(first.withColumn("n", best).where(F.col("n") <= positives).drop("n"))
    windows = first.groupBy(F.col("anchor").alias("rid")).agg(F.collect_list("score").alias("positives"))
    others = asked(wanted.join(windows, "rid")).cogroup(dealt).applyInArrow(_negatives(negatives, low, high), first.schema)
    packed = first.withColumn("negative", F.lit(False)).unionByName(others.withColumn("negative", F.lit(True)))
    stream = packed.repartition("anchor").sortWithinPartitions("anchor", F.desc("score"), "negative", F.asc_nulls_last("id"), "rid")
    return stream.mapInArrow(_mined(negatives, low, high), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def mine_relabelled(vectors: DataFrame) -> DataFrame:
    """mine() after the label of each row whose vec_id is divisible by 7 became (label + 1) % 10."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", "embedding", moved.alias("label")))
