"""A Parquet table that batches are merged into, by ranges of dates and one manifest a version.

A manifest is a small JSON file that names the folder of each range of dates, and of each part of the table of last
dates by key. A merge writes new folders for the ranges and parts that its batch touches, and then the next manifest:
that file appearing under its final name is the commit, so readers see the version before or after, never half of one.
What a failed merge left behind is not named anywhere, and the same batch writes it anew.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType



class VersionedTable:
    """key, date and order name columns of the rows; grain is the length of a date range (as in date_trunc).

    A merge keeps of its batch what lies after the last date of its key, or with replace=True also what corrects older
    rows; of rows of equal key and date the last loaded stays. Rows of a blank key go.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str = "Company", date: str = "Date", order: str = "load", grain: str = "month", parts: int = 16):
        self.spark, self.path, self.schema, self.key, self.date, self.order, self.grain, self.parts = spark, path.rstrip("/"), schema, key, date, order, grain, parts

    # files

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), at

    def _names(self, path: str) -> list[str]:
        fs, at = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names(f"{self.path}/_manifests") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """That of a version, or the last one; before the first merge an empty one."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "batch": -1, "ranges": {}, "seen": {}}
        rows = self.spark.read.text(f"{self.path}/_manifests/{version:010d}.json", wholetext=True).collect()
        return json.loads(rows[0][0])

    def _commit(self, manifest: dict) -> None:
        final = f"{self.path}/_manifests/{manifest['version']:010d}.json"
        fs, tmp = self._fs(f"{final}.tmp")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        if not fs.rename(tmp, self._fs(final)[1]):
            raise RuntimeError(f"version {manifest['version']} was committed by somebody else")

    # rows

    def _read(self, folders: list[str], schema: StructType) -> DataFrame:
        full = [f"{self.path}/{f}" for f in sorted(set(folders))]
        return self.spark.read.schema(schema).parquet(*full) if full else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None, since=None, until=None) -> DataFrame:
        """The rows of a version; only ranges that may hold dates from since to until are opened."""
        ranges = self.manifest(version)["ranges"]
        first = {r: d for r, d in ranges.items() if until is None or r <= str(until)}
        if since is not None:  # the last range that begins at or before it, and all later ones
            least = max((r for r in ranges if r <= str(since)), default="")
            first = {r: d for r, d in first.items() if r >= least}
        rows = self._read(list(first.values()), self.schema)
        rows = rows if since is None else rows.where(F.col(self.date) >= F.lit(since))
        return rows if until is None else rows.where(F.col(self.date) <= F.lit(until))

    def merge(self, batch: DataFrame, number: int, replace: bool = False) -> dict:
        """The manifest after the batch. A number that was merged already changes nothing, so a replay is harmless."""
        before = self.manifest()
        if number <= before["batch"]:
            return before
        version = before["version"] + 1
        part = F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")
        fresh = batch.select(*self.schema.names).where(F.col(self.key).isNotNull() & (F.trim(F.col(self.key).cast("string")) != ""))
        fresh = fresh.withColumns({"_part": part, "_range": F.date_format(F.date_trunc(self.grain, self.date), "yyyy-MM-dd")}).persist()
        try:
            touched = [r[0] for r in fresh.select("_part").distinct().collect()]  # at most `parts`
            seen_schema = StructType([self.schema[self.key], self.schema[self.date]])
            seen = self._read([before["seen"][str(p)] for p in touched if str(p) in before["seen"]], seen_schema).withColumnRenamed(self.date, "_seen")
            kept = fresh if replace else fresh.join(seen, self.key, "left").where(F.col("_seen").isNull() | (F.col(self.date) > F.col("_seen"))).drop("_seen")
            ranges = sorted(r[0] for r in kept.select("_range").distinct().collect() if r[0])  # as many as the batch has ranges of dates
            old = self._read([before["ranges"][r] for r in ranges if r in before["ranges"]], self.schema)
            old = old.withColumn("_range", F.date_format(F.date_trunc(self.grain, self.date), "yyyy-MM-dd"))
            newest = Window.partitionBy(self.key, self.date).orderBy(F.col(self.order).desc_nulls_last())
            rows = old.unionByName(kept.drop("_part")).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
            rows.repartition("_range", F.pmod(F.xxhash64(self.key), F.lit(8))).write.mode("overwrite").partitionBy("_range").parquet(f"{self.path}/data/v={version}")
            last = kept.groupBy(self.key).agg(F.max(self.date).alias(self.date)).unionByName(seen.withColumnRenamed("_seen", self.date))
            last = last.groupBy(self.key).agg(F.max(self.date).alias(self.date)).withColumn("_part", part)
            last.repartition("_part").write.mode("overwrite").partitionBy("_part").parquet(f"{self.path}/seen/v={version}")
        finally:
            fresh.unpersist()
        wrote = {n.removeprefix("_range="): f"data/v={version}/{n}" for n in self._names(f"{self.path}/data/v={version}") if n.startswith("_range=")}
        parts = {n.removeprefix("_part="): f"seen/v={version}/{n}" for n in self._names(f"{self.path}/seen/v={version}") if n.startswith("_part=")}
        after = {"version": version, "batch": number, "ranges": before["ranges"] | wrote, "seen": before["seen"] | parts}
        self._commit(after)
        return after

    def clear(self, keep: int = 2) -> None:
        """Delete all but the last `keep` versions, and the folders that none of those names."""
        versions = sorted(self.versions())
        kept = [self.manifest(v) for v in versions[-keep:]]
        if not kept:
            return
        named = {d for m in kept for d in (*m["ranges"].values(), *m["seen"].values())}
        for v in versions[:-keep]:
            fs, at = self._fs(f"{self.path}/_manifests/{v:010d}.json")
            fs.delete(at, False)
        for kind in ("data", "seen"):
            for v in self._names(f"{self.path}/{kind}"):
                if int(v.removeprefix("v=")) > versions[-1]:
                    continue  # somebody is writing it
                folders = [f"{kind}/{v}/{n}" for n in self._names(f"{self.path}/{kind}/{v}") if "=" in n]
                for gone in [f for f in folders if f not in named] if any(f in named for f in folders) else [f"{kind}/{v}"]:
                    fs, at = self._fs(f"{self.path}/{gone}")
                    fs.delete(at, True)
