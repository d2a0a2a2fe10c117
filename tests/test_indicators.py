from barloom.plans import views
from barloom.queries import queries

DIRECTORY = "/root/testdata/sf0.001"


def test_every_market_segment_is_an_indicator(spark):
    segments = {r[0] for r in views.table(spark, DIRECTORY, "customer").select("c_mktsegment").distinct().collect()}
    assert set(queries()["c21_attach_indicators"](spark, DIRECTORY).columns) == {"iso3"} | segments
