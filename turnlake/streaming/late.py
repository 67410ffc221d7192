"""Sessions over a stream whose captures arrive late and out of order.

A capture can only be numbered when all earlier ones of its wallet are known.
Captures wait in the state store, in a list per wallet, until the watermark says
that nothing older can come; a timer then releases them in time order. The rule
is that of ``operators.sessions``, so any order of arrival within the allowed
lateness gives what the batch operator gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from turnlake.operators.sessions import usable

WAITING = "capture_id string, ts timestamp, tool string, n bigint"
LAST = "tool string, n bigint, session_no bigint"
OUTPUT = "wallet_id bigint, capture_id string, ts timestamp, tool string, n bigint, session_no bigint"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = ["capture_id", "ts", "tool", "n"]


def _milliseconds(ts: pd.Timestamp) -> int:
    return int(ts.value // 1_000_000)


class _Numbering(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.last = handle.getValueState("last", LAST)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = set(self.handle.listTimers())
        for batch in rows:  # one Arrow batch at a time; nothing is gathered
            self.waiting.appendList([tuple(r) for r in batch[COLUMNS].itertuples(index=False, name=None)])
            # One timer for each time a capture bears: it fires once the watermark has passed it.
            due = {_milliseconds(ts) + 1 for ts in batch["ts"]} - known
            for time in sorted(due):
                self.handle.registerTimer(time)
            known |= due
        return iter(())  # nothing is numbered before its time has come

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get())
        ready = [r for r in held if _milliseconds(pd.Timestamp(r[1])) < watermark]
        if not ready:  # released with an earlier timer of this batch
            return
        later = [r for r in held if _milliseconds(pd.Timestamp(r[1])) >= watermark]
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        tool, n, number = self.last.get() if self.last.exists() else (None, -1, 0)
        out = []
        for capture_id, ts, own_tool, own_n in sorted(ready, key=lambda r: (r[1], r[0])):
            if not (own_tool == tool and own_n > n):
                number += 1
            tool, n = own_tool, own_n
            out.append((key[0], capture_id, ts, own_tool, own_n, number))
        self.last.update((tool, int(n), int(number)))
        yield pd.DataFrame(out, columns=["wallet_id", *COLUMNS, "session_no"])

    def close(self) -> None:
        pass


def number_sessions(captures: DataFrame, marker: str, lateness: str) -> DataFrame:
    """Add ``session_no`` to a capture stream in any order, kept per wallet in the state store.

    A capture waits until one that is ``lateness`` younger has been seen in any
    wallet, so state grows with the lateness allowed, not with the stream; what
    comes later than that is dropped, as watermarks do. A source that falls
    silent should send a row without capture_id now and then, which only moves
    the time on. The state store must be RocksDB, which is set here.
    """
    captures.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    # Naming ts keeps the condition behind the watermark, which has to see every row.
    timed = captures.withWatermark("ts", lateness).filter(F.col("ts").isNotNull() & F.when(F.col("ts").isNotNull(), F.col("capture_id").isNotNull()))
    rows = usable(timed, marker).select("wallet_id", "capture_id", "ts", "tool", F.col("n").cast("bigint").alias("n"))
    return rows.groupBy("wallet_id").transformWithStateInPandas(
        statefulProcessor=_Numbering(), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime"
    )
