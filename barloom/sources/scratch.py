"""Folders for intermediate tables that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions that name none, by application.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, or the context's checkpoint folder: executors all see it.

    Only a local session with neither (tests, a laptop) gets a folder of its own; a cluster without one is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _own[app] = _own.get(app) or f"file://{tempfile.mkdtemp(prefix='barloom-')}"
    return f"{base.rstrip('/')}/barloom-{uuid.uuid4().hex}"


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, read by whoever needs it."""
    path, spark = shared_dir(df.sparkSession), df.sparkSession
    if not partition_by:
        df.write.parquet(path)
    else:  # a task keeps a file open for each value, where it would sort its rows by them first; small row groups bound what that holds
        before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
        spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", "32")
        try:
            df.write.option("parquet.block.size", str(16 << 20)).partitionBy(*partition_by).parquet(path)
        finally:
            spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", before)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._written = path
    return back


def version(df: DataFrame) -> frozenset:
    """(path, length, time) of each file that df reads now: another value once any of them is replaced, added or gone."""
    files = df.inputFiles()
    if not files:
        return frozenset()
    now = df.sparkSession.read.format("binaryFile").load(files).select("path", "length", "modificationTime")
    return frozenset(tuple(r) for r in now.collect())  # one row a file, which the driver's file index holds as well


class Stored:
    """Tables that several queries of a session read: written once for a version of their input, and again when it changes.

    A table of an older version is deleted as soon as a newer one is written; one whose folder was cleared is written anew.
    """

    def __init__(self):
        self._held: dict[tuple, tuple[frozenset, DataFrame]] = {}

    def get(self, name: str, source: str, inputs: DataFrame, make: Callable[[], DataFrame], *partition_by: str) -> DataFrame:
        """The table of this name over a source, which make() gives from what `inputs` reads."""
        key, now = (inputs.sparkSession.sparkContext.applicationId, name, source), version(inputs)
        before, table = self._held.get(key, (None, None))
        if before != now or not _exists(table):
            if table is not None:
                release(table)
            table = written(make(), *partition_by)
            self._held[key] = now, table
        return table

    def clear(self) -> None:
        """Delete everything that is held."""
        for _, table in self._held.values():
            release(table)
        self._held.clear()


def _exists(df: DataFrame) -> bool:
    hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
    return hadoop.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).exists(hadoop)


def release(*tables: DataFrame) -> None:
    """Delete what was written for these tables, once nothing reads it any more."""
    for df in tables:
        if path := getattr(df, "_written", None):
            hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(hadoop, True)
