"""Runs of events on a stream: an extension beyond batch, with state for each key.

A session closes when its key has had no event for `gap` of event time; it comes
out once, when the watermark has passed that point.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SESSION = "start timestamp, end timestamp, n bigint"
STATE = "starts array<bigint>, ends array<bigint>, counts array<bigint>"


def sessions(events: DataFrame, key: str, time: str, gap_ms: int, late: str = "10 minutes") -> DataFrame:
    """key, start, end, n of closed sessions. Events closer than gap_ms merge; late ones within the watermark merge backwards.

    State holds open sessions only: those that a row not yet late could extend.
    """
    kind = dict(events.dtypes)[key]

    def step(k, frames, state: GroupState):
        open_ = list(zip(*(list(x) for x in state.get), strict=True)) if state.exists else []
        for pdf in frames:
            open_ += [(t, t, 1) for t in (pdf[time].astype("datetime64[ms]").astype("int64")).tolist()]
        merged: list[list[int]] = []
        for a, b, n in sorted(open_):
            if merged and a - merged[-1][1] < gap_ms:
                merged[-1][1] = max(merged[-1][1], b)
                merged[-1][2] += n
            else:
                merged.append([a, b, n])
        mark = state.getCurrentWatermarkMs()
        done = [s for s in merged if s[1] + gap_ms <= mark]
        left = [s for s in merged if s[1] + gap_ms > mark]
        if left:
            state.update(tuple([s[i] for s in left] for i in range(3)))
            state.setTimeoutTimestamp(min(s[1] for s in left) + gap_ms)
        elif state.exists:
            state.remove()
        if done:
            yield pd.DataFrame({key: [k[0]] * len(done), "start": pd.to_datetime([s[0] for s in done], unit="ms"), "end": pd.to_datetime([s[1] for s in done], unit="ms"), "n": [s[2] for s in done]})

    marked = events.withWatermark(time, late).select(key, time)
    return marked.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {SESSION}", STATE, "append", GroupStateTimeout.EventTimeTimeout)


def windows(events: DataFrame, key: str, time: str, length: str, late: str = "10 minutes") -> DataFrame:
    """Counts of tumbling windows by key, by built-in operators."""
    from pyspark.sql import functions as F

    return events.withWatermark(time, late).groupBy(key, F.window(time, length)).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")
