"""Exact ranks and carried values inside groups of any size: no task sorts more than its range of values.

Rows are dealt by ranges of (group, value, hash), so a group of a billion rows is many ranges, and so is a value that a
third of them share. What a row needs of its own range is a window; what it needs of the ranges before (how many rows,
how many of the values at a cut, the last value known) comes from one row for each group and range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.scratch import written


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


#: Rows of a range, about: what one task sorts.
RANGE = 200_000


def ranged(df: DataFrame, by: list[str], *order: str | Column, rows: int = RANGE) -> DataFrame:
    """df with _range: ranges of (by, order) in ascending number, cut anywhere between rows, of about `rows` rows whatever df has."""
    spark = df.sparkSession
    many = max(spark.sparkContext.defaultParallelism, -(-df.count() // rows))
    spread = df.withColumn("_tie", F.xxhash64(*df.columns)).repartitionByRange(many, *by, *order, "_tie")
    return spread.withColumn("_range", F.spark_partition_id()).drop("_tie")


#: Rows of what was found for ranges and groups that every task may hold.
FEW = 100_000


def _joined(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """rows with what was found for their keys; null is a key like any other. Where that is few rows, `rows` stay where they are."""
    other = found.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    if found.limit(FEW + 1).count() <= FEW:
        other = F.broadcast(other)
    return rows.join(other, reduce(lambda x, y: x & y, (_same(k, f"_k_{k}") for k in keys))).drop(*(f"_k_{k}" for k in keys))


def average_rank(df: DataFrame, value: str, by: list[str], rank: str, share: bool = True) -> DataFrame:
    """df with the rank of value within `by`, from 1, ties averaged; as a share of the group's rows if asked for.

    Rows without value have no rank and are not counted. Null is a group like any other.
    """
    names = df.columns
    given = df.where(F.col(value).isNotNull())
    cell = Window.partitionBy("_range", *by)
    local = ranged(given, by, value).withColumns({"_r": F.rank().over(cell.orderBy(value)), "_t": F.count("*").over(Window.partitionBy("_range", *by, value))})
    local = written(local)
    cells = local.groupBy("_range", *by).agg(F.count("*").alias("_n"), F.min(value).alias("_low"), F.max(value).alias("_high"), F.min_by("_t", value).alias("_t_low"), F.max_by("_t", value).alias("_t_high"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_n")
    cells = cells.withColumns({"_before": before, "_all": F.sum("_n").over(Window.partitionBy(*by))})
    # a value at an end of a range: what stands before its first row, and all its rows, over the ranges that have it there
    low = F.struct(F.col("_low").alias("v"), F.col("_t_low").alias("t"), F.col("_before").alias("b"))
    high = F.struct(F.col("_high").alias("v"), F.col("_t_high").alias("t"), (F.col("_before") + F.col("_n") - F.col("_t_high")).alias("b"))
    both = F.when(F.col("_low") == F.col("_high"), F.array(low)).otherwise(F.array(low, high))
    ends = cells.select(*by, F.inline(both)).groupBy(*by, "v").agg((F.min("b") + (F.sum("t") + 1) / 2).alias("_at"))
    cells, ends = written(cells), written(ends)
    for side in ("low", "high"):
        cells = _joined(cells, ends.withColumnsRenamed({"v": f"_{side}", "_at": f"_at_{side}"}), [*by, f"_{side}"])
    found = _joined(local, written(cells), ["_range", *by])  # a row for each group and range
    at = F.when(F.col(value) == F.col("_low"), F.col("_at_low")).when(F.col(value) == F.col("_high"), F.col("_at_high")).otherwise(F.col("_before") + F.col("_r") + (F.col("_t") - 1) / 2)
    ranked = found.select(*(c for c in names if c != rank), (at / F.col("_all") if share else at.cast("double")).alias(rank))
    return ranked.unionByName(df.where(F.col(value).isNull()).withColumn(rank, F.lit(None).cast("double")).select(*ranked.columns))


def position(df: DataFrame, order: list[str], by: list[str], at: str, size: str) -> DataFrame:
    """df with each row's place within `by` in ascending `order`, from 1, and the number of the group's rows."""
    local = written(ranged(df, by, *order).withColumn(at, F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order)).cast("long")))
    cells = local.groupBy("_range", *by).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_n")
    cells = cells.select("_range", *by, before.alias("_before"), F.sum("_n").over(Window.partitionBy(*by)).alias(size))
    return _joined(local, written(cells), ["_range", *by]).withColumn(at, F.col(at) + F.col("_before")).drop("_range", "_before")


def last_known(df: DataFrame, value: str, by: list[str], order: list[str], out: str) -> DataFrame:
    """df with the last value that is not null at or before each row of `by` in ascending `order`; null before the first."""
    upto = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = written(ranged(df, by, *order).withColumn(out, F.last(value, ignorenulls=True).over(upto)))
    cells = local.groupBy("_range", *by).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("_range", *by, before.alias("_before"))  # one row for each group and range
    return _joined(local, written(cells), ["_range", *by]).withColumn(out, F.coalesce(out, "_before")).drop("_range", "_before")
