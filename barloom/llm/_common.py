"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.scratch import release, shared_dir

__all__ = ["bitmap_hit", "bitmap_prefilter", "connected_components", "free_name", "materialize", "release", "shared_dir", "small_batches", "table", "with_range_cells", "worker_cache"]

#: Rows of a batch that goes to a Python worker.
ARROW_ROWS = 2_000
#: What a Python worker remembers.
_remembered: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, Python workers get at most ARROW_ROWS rows a batch: whole texts are in them, and some are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(ARROW_ROWS, int(before)) if int(before) > 0 else ARROW_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, executors can be lost."""
    spark = df.sparkSession
    path = shared_dir(spark)
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written = path
    return back


def worker_cache(owner: str, make):
    """What a Python worker remembers for an operator; a worker that turns to another operator forgets it."""
    if _remembered.get("owner") != owner:
        _remembered.clear()
        _remembered.update(owner=owner, held=make())
    return _remembered["held"]


def free_name(df: DataFrame, name: str) -> str:
    """name with so many underscores in front that no column of df (in any letter case) has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_range_cells(df: DataFrame, column: str, cells: int, name: str = "cell") -> DataFrame:
    """df with a cell number for each row, in the order of an integer column: about `cells` ranges of like row counts.

    Two levels of percentiles, each of at most the root of `cells` numbers (and never over 1000): that is all the driver
    sees, and at most 8 MB are broadcast. Null values are of cell -1, and equal values share a cell.
    """
    wide = min(1000, math.isqrt(max(1, cells) - 1) + 1)
    value = F.col(column)
    if wide == 1:
        return df.withColumn(name, F.when(value.isNull(), -1).otherwise(0).cast("long"))
    cut = F.percentile_approx(column, F.array(*(F.lit(i / wide) for i in range(1, wide))), F.lit(100 * wide))
    first = sorted(set(df.agg(cut).first()[0] or []))
    outer = F.size(F.filter(F.array(*map(F.lit, first)).cast("array<long>"), lambda x: x <= value))
    inner = [(r["o"], sorted(set(r["q"]))) for r in df.where(value.isNotNull()).groupBy(outer.alias("o")).agg(cut.alias("q")).collect()]
    known = df.sparkSession.createDataFrame(inner, "_outer int, _inner array<long>")
    within = F.size(F.filter("_inner", lambda x: x <= value))
    placed = df.withColumn("_outer", outer).join(F.broadcast(known), "_outer", "left")
    return placed.withColumn(name, F.when(value.isNull(), -1).otherwise(F.col("_outer") * (wide + 1) + within).cast("long")).drop("_outer", "_inner")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is its smallest reachable node.

    Alternating large-star and small-star contractions: each pass is two grouped minima and two joins, and the
    number of passes grows with the logarithm of the diameter. Minima are combined on the map side, so a node with
    very many neighbours sends few rows; each pass ends in a written table. Null ends and self loops are ignored.
    """
    edges = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    )
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges, before = materialize(small), edges
        release(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct()).distinct()


def bitmap_hit(df: DataFrame, key: str, wanted: DataFrame, name: str, bits: int = 23) -> DataFrame:
    """df with the boolean `name`: whether the hashed key may be among wanted's (false: it is surely not).

    Keys are folded onto 2**bits positions of a bitmap, so what is broadcast is 2**bits / 8 bytes at the most, at any
    input size.
    """
    position = F.pmod(F.xxhash64(key), F.lit(2**bits)) + 1
    maps = wanted.select(position.alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_map"))
    spot, bucket = free_name(df, "_p"), free_name(df, "_bucket")
    placed = df.withColumns({spot: position}).withColumn(bucket, F.bitmap_bucket_number(spot))
    bit = F.bitmap_bit_position(spot)
    octet = F.conv(F.hex(F.substr("_map", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(octet, (bit % 8).cast("int")) == 1, F.lit(False))
    maps = maps.withColumnRenamed("_bucket", bucket)
    return placed.join(F.broadcast(maps), bucket, "left").select(*(F.col(f"`{c}`") for c in df.columns), hit.alias(name))


def bitmap_prefilter(df: DataFrame, key: str, wanted: DataFrame, bits: int = 23) -> DataFrame:
    """The rows of df whose key may be among those of wanted (which has the same column), to thin out what a join shuffles.

    Rows are only left out if their key is surely not wanted; the exact join comes after this.
    """
    return bitmap_hit(df, key, wanted, "_hit", bits).where("_hit").drop("_hit")
