"""Two devices' signals on one clock: the lag between them, and one moved onto the other's samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fills
from .windows import KEY

#: Pairs that a task correlates at once.
BLOCK = 1024


def _correlations(a: np.ndarray, b: np.ndarray, lags: list[int], method: str) -> np.ndarray:
    """Rows of pairs by lags: what spectral.xcorr() gives, for a block of pairs."""
    centred = lambda x: x - x.mean(axis=1, keepdims=True)
    if method == "whole":
        norm = np.sqrt((centred(a) ** 2).sum(axis=1) * (centred(b) ** 2).sum(axis=1)) + 1e-9
    else:
        a, b = centred(a), centred(b)
        a, b = (centred(a * a), centred(b * b)) if method == "squared" else (a, b)
        norm = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1)) + 1e-12
    n = a.shape[1]
    # b[i + lag] against a[i]
    return np.stack([(a[:, max(0, -k) : n - max(0, k)] * b[:, max(0, k) : n - max(0, -k)]).sum(axis=1) for k in lags], axis=1) / norm[:, None]


def best_lag(pairs: DataFrame, n: int, max_lag: int, method: str = "squared", closed: bool = True) -> DataFrame:
    """rec_id, lag, r: the lag in samples with the largest correlation of b with a, of equal ones the least; pairs(rec_id, a, b)
    are arrays of n samples. Without closed, max_lag itself is not tried."""
    lags = list(range(-max_lag, max_lag + closed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                # a pair with a null has no correlation, and so the least lag
                best, r = np.full(batch.num_rows, lags[0], np.int32), np.full(batch.num_rows, np.nan)
                a, b = (batch.column(c) for c in "ab")
                full = [_full(x, n) for x in (a, b)]
                own = full[0] & full[1]
                if own.any():
                    a, b = (x.filter(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n) for x in (a, b))
                    found = _correlations(a, b, lags, method)
                    best[own], r[own] = np.array(lags)[np.round(found, 9).argmax(axis=1)], found.max(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(KEY), pa.array(best), pa.array(r, mask=~own)], [KEY, "lag", "r"])

    kind = pairs.schema[KEY].dataType.simpleString()
    ready = pairs.select(KEY, *[F.col(c).cast("array<double>").alias(c) for c in "ab"])
    return ready.mapInArrow(run, f"{KEY} {kind}, lag int, r double")


def _full(x: pa.ListArray, n: int) -> np.ndarray:
    """Which rows are arrays of n values, none of them null."""
    sizes = np.diff(x.offsets.to_numpy())
    ends = x.offsets.to_numpy()
    nulls = np.concatenate([[0], np.cumsum(x.values.is_null().to_numpy(zero_copy_only=False))])
    return (sizes == n) & ~x.is_null().to_numpy(zero_copy_only=False) & (nulls[ends[1:]] == nulls[ends[:-1]])


def aligned(ref: DataFrame, other: DataFrame, shift: DataFrame) -> DataFrame:
    """rec_id, x, ref, other: other, moved back by its recording's shift, on the line between its samples at the places x of ref
    inside both signals. ref and other are samples(rec_id, x, v), shift(rec_id, shift); rates may differ.

    A recording whose signals do not overlap once moved raises an error; one without a shift is left out.
    """
    span = lambda df, a, b: df.groupBy(KEY).agg(F.min("x").alias(a), F.max("x").alias(b))
    moved = other.join(shift, KEY).select(KEY, (F.col("x") - F.col("shift")).alias("x"), "v")
    both = span(ref, "r0", "r1").join(span(moved, "m0", "m1"), KEY)
    both = both.select(KEY, F.greatest(F.lit(0.0), "r0", "m0").alias("start"), F.least("r1", "m1").alias("end"))
    both = both.withColumn("start", F.when(F.col("end") > F.col("start"), F.col("start")).otherwise(F.raise_error(F.lit("no overlap after the shift")).cast("double")))
    clip = lambda df: df.join(both, KEY).where((F.col("x") >= F.col("start")) & (F.col("x") <= F.col("end"))).select(KEY, "x", "v")
    grid = clip(ref)
    found = fills.on_grid(clip(moved), grid.select(KEY, "x"))
    return grid.withColumnRenamed("v", "ref").join(found.withColumnRenamed("v", "other"), [KEY, "x"])
