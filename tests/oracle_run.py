"""Compare registered queries with their SQL on one scale factor: python tests/oracle_run.py sf0.001 [prefix ...]."""

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return "nan" if isinstance(x, float) and math.isnan(x) else f"{float(x):.9g}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return repr(x)


def duck(directory):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        path = f"{directory}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return c


def compare(spark, con, directory, fn, sql):
    """Nothing if all rows are equal, else what differs."""
    df = fn(spark, directory)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    cur = con.execute(sql)
    there = [x[0] for x in cur.description]
    if sorted(there) != names:
        return f"columns {names} against {sorted(there)}"
    at = [there.index(c) for c in names]
    want = sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    if got == want:
        return ""
    odd = [(a, b) for a, b in zip(got, want) if a != b][:2]
    return f"{len(got)} against {len(want)} rows; {odd}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    os.environ["PYTHONPATH"] = sys.path[0]
    import importlib

    directory = f"/root/testdata/{sys.argv[1]}"
    spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(directory)
    only = sys.argv[2:]
    for m in only or importlib.import_module("barloom.queries").MODULES:
        mod = importlib.import_module(f"barloom.plans.{m}")
        for name, (fn, _) in mod.QUERIES.items():
            t = time.time()
            try:
                said = compare(spark, con, directory, fn, mod.ORACLES[name]) if name in mod.ORACLES else f"rows {fn(spark, directory).count()}"
            except Exception as e:  # noqa: BLE001
                said = f"ERROR {type(e).__name__} {str(e)[:400]}"
            if said:
                print(name, round(time.time() - t, 1), said, flush=True)
    print("done")
