"""Exact duplicates by a tree-merge of sorted digest runs.

Every input partition becomes a run: one entry per text, in the order of a 64-bit digest. Runs lie on sites, and a site
is a number of `bits` binary digits. In a round, sites whose numbers differ in the next few digits alone exchange
entries (a group of binomial rounds at once, so what meets is merged many ways): an entry goes to the site of its group
whose digits are those of its digest. Entries of equal texts that meet become one, so a text that half of all rows have
is, in every round, at most one entry from each of the few runs that a task merges. After the last round each digest has
one site. Sizes and the row that stays then go back down the same tree, so that no join has more than a few entries for
a key on one side, and a few partitions' rows on the other.

Equal digests are never enough: entries merge only if the SHA-256 of their texts agree too, at every level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.sources.scratch import written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Binomial rounds in one exchange: up to 2**ROUNDS runs are merged by a task.
ROUNDS = 3

_KEY = ("site", "digest", "sha")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries that follow one another with an equal key, the last, with the sum of their sizes."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        b = pa.RecordBatch.from_arrays(b.columns, names=b.schema.names)  # every column may be null, as in what is held
        b = pa.Table.from_batches([*held, b]).combine_chunks().to_batches()[0]
        n = len(b)
        ends = np.ones(n, bool)
        ends[:-1] = ~np.logical_and.reduce([pc.equal(b.column(c)[1:], b.column(c)[:-1]).to_numpy(zero_copy_only=False) for c in _KEY])
        last = np.flatnonzero(ends)
        size = np.add.reduceat(b.column("size").to_numpy(), np.concatenate([[0], last[:-1] + 1]))
        out = b.take(pa.array(last))
        out = out.set_column(out.schema.get_field_index("size"), "size", pa.array(size, pa.int64()))
        held = [out.slice(len(out) - 1)]
        if len(out) > 1:
            yield out.slice(0, len(out) - 1)
    yield from held


def _moved(site: Column | str, digest: str, low: int, width: int) -> Column:
    """The site with `width` binary digits from `low` on replaced by the digest's."""
    mask = ((1 << width) - 1) << low
    kept = (F.col(site) if isinstance(site, str) else site).bitwiseAND(F.lit(~mask))
    return kept.bitwiseOR(F.col(digest).bitwiseAND(F.lit(mask)).cast("int"))


def dedup(docs: DataFrame, keep: str = "largest", digest_bits: int = 63, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs (doc_id, text).

    Texts are equal if they are the same after A-Z alone are lower-cased; null is the empty text. Of equal texts the row
    of the largest doc_id stays (or of the smallest); of rows that repeat that id, exactly one. Rows without doc_id stay
    only in a group without any id, whose keep_id is null. Texts are read once and whole, and only digests move. Further
    columns are left out; an empty table gives no rows. A digest of fewer bits makes more digests agree (for tests).
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is largest or smallest")
    spark = docs.sparkSession
    bits = max(1, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    sites = 1 << bits
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower())
    order = F.asc_nulls_first("doc_id") if keep == "largest" else F.desc_nulls_first("doc_id")
    # the runs of the leaves: each task of this scan writes its rows in order, and row tells where one was written
    rows = docs.select("doc_id", F.xxhash64(text).bitwiseAND(F.lit((1 << digest_bits) - 1)).alias("digest"), F.unhex(F.sha2(text, 256)).alias("sha"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows.sortWithinPartitions("digest", "sha", order, "row"))
    rows = rows.withColumn("site", F.shiftright("row", 33).bitwiseAND(F.lit(sites - 1)).cast("int"))

    run = rows.select(*_KEY, "doc_id", "row", F.lit(1).cast("long").alias("size"))
    run = run.mapInArrow(_merged, run.schema)
    steps = [(low, min(rounds, bits - low)) for low in range(0, bits, rounds)]
    runs = []
    for low, width in steps:
        met = run.withColumn("site", _moved("site", "digest", low, width)).repartitionById(sites, "site")
        run = written(met.sortWithinPartitions(*_KEY, order, "row").mapInArrow(_merged, run.schema))
        runs.append(run)

    found = runs[-1].where("size > 1").select(*_KEY, F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("size").alias("group_size"))
    for lower, (low, width) in zip(runs[-2::-1], steps[:0:-1], strict=True):
        up = lower.select(*_KEY, _moved("site", "digest", low, width).alias("to"))
        found = up.join(found.withColumnRenamed("site", "to"), ["to", "digest", "sha"]).drop("to")
    told = rows.withColumn("site", _moved("site", "digest", *steps[0])).join(found, [*_KEY], "left")
    alone = F.col("group_size").isNull()
    return told.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
