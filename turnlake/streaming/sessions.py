"""Sessions over a stream of captures, with the rule of ``operators.sessions``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnlake.operators.sessions import usable

STATE = "tool string, n bigint, session_no bigint"
OUTPUT = "wallet_id bigint, capture_id string, ts timestamp, tool string, n bigint, session_no bigint"


def number_sessions(captures: DataFrame, marker: str) -> DataFrame:
    """Add ``session_no`` to a capture stream, kept per wallet in the state store.

    A wallet's rows of one micro-batch are handled together; the source's
    ``maxFilesPerTrigger`` bounds them.
    """

    def number(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "capture_id"])
        tool, n, session_no = state.get if state.exists else (None, -1, 0)
        before_tool = rows["tool"].shift(1).fillna(tool if tool is not None else "")
        before_n = rows["n"].shift(1).fillna(n)
        starts = ~((rows["tool"] == before_tool) & (rows["n"] > before_n))
        rows["session_no"] = session_no + starts.cumsum()
        last = rows.iloc[-1]
        state.update((str(last["tool"]), int(last["n"]), int(last["session_no"])))
        yield rows[["wallet_id", "capture_id", "ts", "tool", "n", "session_no"]]

    rows = usable(captures, marker).select(
        "wallet_id", "capture_id", "ts", "tool", F.col("n").cast("bigint").alias("n")
    )
    return rows.groupBy("wallet_id").applyInPandasWithState(
        number, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout
    )
