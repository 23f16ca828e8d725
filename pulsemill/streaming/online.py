"""Structured Streaming forms: windowed heart rate, recordings split at gaps, and beats thinned with state.

The input is a stream of beats (rec_id, ts timestamp, value).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_rate(beats: DataFrame, size: str = "10 seconds", stride: str = "5 seconds", late: str = "10 seconds") -> DataFrame:
    """rec_id, start, n_beats, hr_bpm, is_usable of every sliding window, once the watermark has passed it."""
    us = lambda c: F.unix_micros(c)
    w = beats.withWatermark("ts", late).groupBy("rec_id", F.window("ts", size, stride).alias("w")).agg(F.count("*").alias("n_beats"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    span = us(F.col("b")) - us(F.col("a"))
    hr = F.when((F.col("n_beats") > 1) & (span > 0), F.round((F.col("n_beats") - 1) * 60e6 / span, 4)).otherwise(0.0)
    return w.select("rec_id", F.col("w.start").alias("start"), "n_beats", hr.alias("hr_bpm"), (F.col("n_beats") >= 4).alias("is_usable"))


def split_at_gaps(beats: DataFrame, gap: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """rec_id, start, end, n_beats of the parts of each recording that have no gap as long as `gap`."""
    s = beats.withWatermark("ts", late).groupBy("rec_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_beats"))
    return s.select("rec_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_beats")


def thinned(beats: DataFrame, refractory_ms: int = 200, rate: float = 0.125) -> DataFrame:
    """rec_id, ts, rr_ms, level of the beats that come more than the refractory time after the last kept one; level is a
    running mean of the intervals. The state is a recording's last beat and its level; it goes after an hour without data."""
    out = "rec_id long, ts timestamp, rr_ms double, level double"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, level = state.get if state.exists else (None, None)
        rows = []
        for ts in pd.concat([b["ts"] for b in batches]).sort_values():
            us = int(ts.value // 1000)
            gap = None if last is None else (us - last) / 1000
            if gap is None or gap > refractory_ms:
                if gap is not None:
                    level = gap if level is None else rate * gap + (1 - rate) * level
                rows.append((key[0], ts, gap, level))
                last = us
        state.update((last, level))
        state.setTimeoutDuration(3_600_000)
        yield pd.DataFrame(rows, columns=["rec_id", "ts", "rr_ms", "level"]).astype({"rr_ms": float, "level": float})

    return beats.groupBy("rec_id").applyInPandasWithState(step, out, "last long, level double", "append", GroupStateTimeout.ProcessingTimeTimeout)
