"""Structured Streaming forms of the incremental load and of the drawdown breaker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.sources.versioned import VersionedTable


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, key: str = "Company", date: str = "Date", order: str = "load", keep: int = 2):
    """A query that merges each batch into the versioned table at path (VersionedTable(...).read() gives its rows).

    A batch rewrites the ranges of dates that it touches and commits one manifest; run again after a failure it does
    so once. The last `keep` versions stay for readers that began before.
    """
    table = VersionedTable(stream.sparkSession, path, stream.schema, key, date, order)

    def merge(batch: DataFrame, b: int) -> None:
        table.merge(batch, b)
        table.clear(keep)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


class _Breaker(StatefulProcessor):
    def __init__(self, most: float):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("peak_halted", "peak double, halted boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        peak, halted = self.state.get() if self.state.exists() else (float("-inf"), False)
        out = []
        for r in pd.concat(list(rows)).sort_values("Date").itertuples(index=False):
            peak = max(peak, r.equity)
            halted = halted or r.equity / peak - 1 <= -self.most
            out.append((key[0], r.Date, r.equity, peak, r.equity / peak - 1, halted))
        self.state.update((float(peak), bool(halted)))
        yield pd.DataFrame(out, columns=["account", "Date", "equity", "peak", "drawdown", "halted"])

    def close(self) -> None:
        pass


def breaker_stream(stream: DataFrame, most: float = 0.05) -> DataFrame:
    """(account, Date, equity, peak, drawdown, halted) of a stream (account, Date, equity); the peak and the latch are state.

    transformWithStateInPandas needs the RocksDB state store.
    """
    schema = "account long, Date date, equity double, peak double, drawdown double, halted boolean"
    return stream.groupBy("account").transformWithStateInPandas(_Breaker(most), schema, "Append", "None")
