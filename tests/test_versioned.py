"""The versioned table against a whole-table merge, after failures, and what it writes."""

import datetime
import os
import random

import pytest
from pyspark.sql.types import DateType, DoubleType, IntegerType, LongType, StructType

from barloom.sources import tables as A
from barloom.sources.versioned import VersionedTable

SCHEMA = StructType().add("Company", LongType()).add("Date", DateType()).add("Close", DoubleType()).add("load", IntegerType())


def day(n):
    return datetime.date(2022, 1, 1) + datetime.timedelta(days=n)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def folders(path):
    return {os.path.relpath(os.path.join(d, x), path) for kind in ("data", "seen") for d, names, _ in os.walk(f"{path}/{kind}") for x in names if x.startswith(("_range=", "_part="))}


def test_merges_like_the_whole_table(spark, tmp_path):
    draw = random.Random(1)
    table = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, parts=4)
    whole = spark.createDataFrame([], SCHEMA)
    assert table.read().count() == 0
    for b in range(4):
        made = [(draw.choice([1, 2, 3, None]), day(draw.randrange(60 * b, 60 * b + 90)), draw.random(), b * 100 + i) for i in range(60)]
        batch = spark.createDataFrame(made + made[:5], SCHEMA)
        whole = spark.createDataFrame(A.upsert_bars(whole, batch).collect(), SCHEMA)
        assert table.merge(batch, b)["version"] == b + 1
        assert rows_of(table.read()) == rows_of(whole)
    since, until = day(100), day(200)
    assert rows_of(table.read(since=since, until=until)) == rows_of(whole.where(f"Date between date '{since}' and date '{until}'"))
    assert table.merge(batch, 3)["version"] == 4 and rows_of(table.read()) == rows_of(whole)  # a replay
    assert rows_of(table.read(version=1)) != rows_of(whole)
    table.clear(keep=1)
    manifest = table.manifest()
    assert table.versions() == [4] and rows_of(table.read()) == rows_of(whole)
    assert folders(tmp_path / "t") == {*manifest["ranges"].values(), *manifest["seen"].values()}


def test_a_batch_rewrites_what_it_touches(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), SCHEMA)
    table.merge(spark.createDataFrame([(c, day(n), 1.0, 0) for c in range(50) for n in range(0, 700, 7)], SCHEMA), 0)
    before = folders(tmp_path / "t")
    manifest = table.merge(spark.createDataFrame([(7, day(699), 2.0, 1)], SCHEMA), 1)
    assert len(manifest["ranges"]) == 24
    assert {f.split("/")[0] for f in folders(tmp_path / "t") - before} == {"data", "seen"} and len(folders(tmp_path / "t") - before) == 2
    late = spark.createDataFrame([(7, day(0), 9.0, 2), (7, day(1), 8.0, 2)], SCHEMA)
    table.merge(late, 2)
    assert table.read().where("Close > 7").count() == 0
    table.merge(late, 3, replace=True)
    assert rows_of(table.read().where("Close > 7")) == rows_of(late) and table.read().count() == 50 * 100 + 2


def test_a_failed_merge_leaves_the_version_before(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, str(tmp_path / "t"), SCHEMA)
    first, second = (spark.createDataFrame([(1, day(n), float(n), n)], SCHEMA) for n in (1, 2))
    table.merge(first, 0)

    def broken(manifest):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(table, "_commit", broken)
        with pytest.raises(OSError):
            table.merge(second, 1)
    assert rows_of(table.read()) == rows_of(first)
    table.merge(second, 1)
    assert rows_of(table.read()) == rows_of(first.union(second))
    with pytest.raises(RuntimeError):
        table._commit(table.manifest())
