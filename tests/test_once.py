"""What several steps read is made once."""

from pyspark.sql import functions as F

from barloom.operators import evaluate as E
from barloom.plans import queries_portfolio as Q


def test_oversampling_makes_its_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    rows = spark.range(600).select((F.col("id") % 10 == 0).cast("int").alias("label"), F.array(F.col("id") * 1.0, F.col("id") % 7 * 1.0).alias("features"))
    out = E.oversample_minority(rows.mapInPandas(count, rows.schema), "label", cell_rows=40)
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {0: 540, 1: 540}
    assert made.value == 600


def test_scored_rows_are_stored(spark):
    scored = Q._scored(spark, "/root/testdata/sf0.001")
    assert "lineitem" not in scored._jdf.queryExecution().toString() and scored.inputFiles() == Q._scored(spark, "/root/testdata/sf0.001").inputFiles()


def test_a_fold_is_prepared_once_for_all_its_models(spark, monkeypatch):
    import datetime

    from pyspark.ml.regression import LinearRegression

    from barloom.operators import walk_forward as W

    dealt, spread = [], W.spread
    monkeypatch.setattr(W, "spread", lambda df, amount: dealt.append(df.columns) or spread(df, amount))
    rows = spark.createDataFrame([(datetime.date(2020, 1, 1) + datetime.timedelta(days=i), float(i % 7), "wide", float(i)) for i in range(400)], "Date date, a double, other string, label double")
    folds = W.Folds(rows, 1, 5, 50)
    out = W.predictions(folds, {"x": ["a"]}, {"one": LinearRegression(labelCol="label"), "two": LinearRegression(labelCol="label", regParam=1.0)}, ["Date"])
    assert out.groupBy("model").count().count() == 2 and out.count() == 2 * folds.test(folds.folds[0]).count()
    assert dealt == [["a", "label", "validation"]]
