"""Bindings of response ids to sessions that end when they are not used.

A binding holds from the time at which it was made; a request that names it in less than the idle time after its last use
resolves and uses it, a later one does not, and only binding it again helps. ``resolved`` tells this of a whole table with
window functions: uses that follow each other in less than the idle time are one run, and a request resolves if its run has a
binding before it. ``resolved_stream`` tells it of a stream with one value state a response id, for any split into micro-batches
of rows that come in the order of their times.

Defined cases: rows of the same time count in the order of ``order``; null ids and times resolve nothing; the last binding
before a request tells its session; without ``idle`` elapsed a binding may be replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FOUND = "response_id string, order long, used_us long, session_key string"


def uses(df: DataFrame, response_id: str, ts: str, order: str, session_key: str) -> DataFrame:
    """response_id, used_us, order, session_key: null in requests, the session in bindings. ``ts`` has no zone."""
    us = ((F.col(ts) - F.lit("1970-01-01").cast("timestamp_ntz")).cast("decimal(20,6)") * 1_000_000).cast("long")
    return df.select(F.col(response_id).cast("string").alias("response_id"), us.alias("used_us"), F.col(order).cast("long").alias("order"), F.col(session_key).alias("session_key"))


def resolved(rows: DataFrame, idle_us: int) -> DataFrame:
    """response_id, order, used_us, session_key of the requests among rows of ``uses``; a null session where none holds."""
    over = Window.partitionBy("response_id").orderBy("used_us", "order")
    known = rows.where("response_id is not null and used_us is not null")
    apart = F.coalesce(F.col("used_us") - F.lag("used_us").over(over) >= idle_us, F.lit(True))
    runs = known.withColumn("__new", apart.cast("int")).withColumn("__run", F.sum("__new").over(over))
    told = F.last("session_key", ignorenulls=True).over(Window.partitionBy("response_id", "__run").orderBy("used_us", "order"))
    found = runs.withColumn("__told", told).where("session_key is null").select("response_id", "order", "used_us", F.col("__told").alias("session_key"))
    none = rows.where("(response_id is null or used_us is null) and session_key is null").select("response_id", "order", "used_us", "session_key")
    return found.unionByName(none)


class Binding(StatefulProcessor):
    """One response id: its session and when it was used last. A timer ends it when streams' clocks say so."""

    def __init__(self, idle_us: int):
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bound = handle.getValueState("bound", "session_key string, used_us long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["used_us", "order"], kind="stable")
        state = tuple(self.bound.get()) if self.bound.exists() else None
        out = []
        for used, order, session in zip(frame["used_us"], frame["order"], frame["session_key"], strict=True):
            if state is not None and used - state[1] >= self.idle_us:
                state = None
            if session is not None:
                state = (session, int(used))
            else:
                out.append((key[0], order, used, state[0] if state else None))
                state = (state[0], int(used)) if state else None
        if state is None:
            self.bound.clear()
        else:
            self.bound.update(state)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((state[1] + self.idle_us) // 1000 + 1)
        yield pd.DataFrame(out, columns=["response_id", "order", "used_us", "session_key"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.bound.clear()
        return iter(())

    def close(self) -> None:
        pass


def resolved_stream(rows: DataFrame, idle_us: int, late: str = "0 seconds") -> DataFrame:
    """As ``resolved`` for a stream of rows of ``uses``; state goes once the watermark, ``late`` behind the last time, has
    passed the idle time. Rows without an id or a time are left out. The state store must be RocksDB."""
    known = rows.where("response_id is not null and used_us is not null").withColumn("at", F.timestamp_micros("used_us"))
    return known.withWatermark("at", late).groupBy("response_id").transformWithStateInPandas(Binding(idle_us), FOUND, "Append", "EventTime")
