"""Hashes of a stream, put out in flushes: after so many new ones, or so long after the last flush, whichever comes first."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Flush(StatefulProcessor):
    """Holds the rows of one shard until `every` are there or `seconds` have passed since its last flush, and then puts them all out.

    Rows are kept in the state store, so a query that starts again from its checkpoint has lost none and goes on counting. A shard's first
    wait begins with its first row. What is put out carries the shard's number of flushes so far and why it came.
    """

    def __init__(self, columns: str, every: int, seconds: float):
        self.columns, self.every, self.wait = columns, every, int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.columns)
        self.mark = handle.getValueState("mark", "held int, flushes long, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held, flushes, due = self.mark.get() or (0, 0, 0)
        if not due:
            due = now + self.wait
            self.handle.registerTimer(due)
        names = [c.split()[0] for c in self.columns.split(", ")]
        for pdf in rows:
            new = list(pdf[names].itertuples(index=False, name=None))
            if new:
                self.rows.appendList(new)
                held += len(new)
        self.mark.update((held, flushes, due))
        if held >= self.every:
            yield self._out(key, flushes, due, now, "count")
        elif held and now > due:
            yield self._out(key, flushes, due, now, "time")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held, flushes, due = self.mark.get() or (0, 0, 0)
        if held:
            yield self._out(key, flushes, due, now, "time")
        else:  # nothing to save: the next row begins a new wait
            self.mark.update((0, flushes, 0))

    def _out(self, key, flushes: int, due: int, now: int, why: str) -> pd.DataFrame:
        if due > now:
            self.handle.deleteTimer(due)
        names = [c.split()[0] for c in self.columns.split(", ")]
        out = pd.DataFrame(list(self.rows.get()), columns=names)
        self.rows.clear()
        self.handle.registerTimer(now + self.wait)
        self.mark.update((0, flushes + 1, now + self.wait))
        return out.assign(shard=key[0], flush=flushes + 1, why=why)[["shard", "flush", "why", *names]]

    def close(self) -> None:
        pass


def flushed(stream: DataFrame, every: int = 10, seconds: float = 300, shards: int = 16, key: str = "uri") -> DataFrame:
    """(shard int, flush long, why string, columns...): the stream's rows in flushes of shards by hash of `key`.

    Needs the session's state store to be RocksDB. Every row comes out once, in the flush after it; null keys are of one shard.
    """
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema)
    x = stream.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))
    return x.groupBy("shard").transformWithStateInPandas(Flush(columns, every, seconds), f"shard int, flush long, why string, {columns}", "Append", "ProcessingTime")
