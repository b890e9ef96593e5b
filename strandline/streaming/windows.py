"""Windows in event time, for streams and tables alike.

These go beyond batch: the same functions take a streaming DataFrame, on which the
watermark bounds the state and says how late an event may come.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sliding(events: DataFrame, time: str, size: str, hop: str, keys: Sequence[str], aggregates: Sequence[Column], late: str = "10 minutes") -> DataFrame:
    """start, end, keys and aggregates of each sliding window."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.window(time, size, hop).alias("w"), *keys).agg(*aggregates).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "*").drop("w")


def sessions(events: DataFrame, time: str, gap: str, keys: Sequence[str], aggregates: Sequence[Column], late: str = "10 minutes") -> DataFrame:
    """start, end, keys and aggregates of runs of events with no gap of that length."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*aggregates).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "*").drop("w")


def carry_forward(events: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """key, time, value of each streamed event, the value carried on from the last event of its key that had one.

    The state of a key is one number.  Within a batch, events are taken in time order.
    """

    def step(of: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames)).sort_values(time, kind="stable")
        last = state.get[0] if state.exists else None
        out = frame[value].astype(float).ffill()
        if last is not None:
            out = out.fillna(last)
        if out.notna().any():
            state.update((float(out.dropna().iloc[-1]),))
        yield pd.DataFrame({key: frame[key], time: frame[time], value: out})

    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    return events.select(key, time, value).groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {time} {kinds[time]}, {value} double", "last double", "append", GroupStateTimeout.NoTimeout)
