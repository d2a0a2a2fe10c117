"""What moves: rows behind folds are computed once, and ranks join what was found for ranges without moving the rows."""

import datetime

from pyspark.sql import functions as F

from barloom.functions.ranges import average_rank
from barloom.operators import walk_forward as W
from barloom.plans import views


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_folds_compute_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(i):
        seen.add(1)
        return i

    rows = spark.range(1200, numPartitions=2).withColumn("i", F.udf(counted, "long")("id"))
    rows = rows.select(F.date_add(F.lit(datetime.date(2020, 1, 1)), (F.col("i") / 10).cast("int")).alias("Date"), "i")
    folds = W.Folds(rows, 5, 5, 50)
    assert sum(folds.test(f).count() for f in folds.folds) > 0 and folds.rows.count() == 1200
    assert seen.value == 1200


def test_ranks_join_small_tables_where_the_rows_are(spark):
    rows = spark.range(3000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 500).alias("v"))
    assert "SortMergeJoin" not in plan(average_rank(rows, "v", ["g"], "r")) and "BroadcastHashJoin" in plan(average_rank(rows, "v", ["g"], "r"))


def test_lines_move_once_on_their_way_to_scores(spark):
    assert plan(views.scores(spark, "/root/testdata/sf0.001")).count("hashpartitioning(Company") == 1
