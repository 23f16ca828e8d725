"""Sequence operators of one recording: differences, rolling statistics, sliding windows and edges.

All windows are partitioned by recording. Frames count rows; sliding windows are joined by arithmetic on their number,
not by comparing times.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY = "rec_id"


def sliced(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows, for what Python objects of a whole batch would fill memory."""
    for batch in batches:
        for lo in range(0, batch.num_rows, most):
            yield batch.slice(lo, most)


def by(*order: str) -> WindowSpec:
    return Window.partitionBy(KEY).orderBy(*order)


def median(x: Column) -> Column:
    return F.percentile(x, 0.5)


def rolling(x: Column, how, order: list[str], before: int, after: int, least: int = 1) -> Column:
    """how(x) over the rows around each row; null where fewer than `least` of them have a value."""
    frame = by(*order).rowsBetween(-before, after)
    return F.when(F.count(x).over(frame) >= least, how(x).over(frame))


def centred(width: int) -> tuple[int, int]:
    """Rows before and after for a centred frame; an even one has one more before."""
    return width // 2, (width - 1) // 2


def mirrored(samples: DataFrame, k: int) -> DataFrame:
    """samples(rec_id, idx, v) with k mirrored rows at either end (d c b a | a b c d | d c b a); _own marks the rows
    that were there. A recording of fewer than k rows repeats its mirror."""
    n = F.max("idx").over(Window.partitionBy(KEY)) + 1
    rows = samples.withColumn("_n", n)
    period = F.col("_n") * 2
    reps = F.ceil(F.lit(k) / period)
    # every place in [-k, n + k) whose mirror is idx: idx + 2nj and -1 - idx + 2nj
    steps = F.sequence(-reps, reps)
    at = F.concat(F.transform(steps, lambda j: F.col("idx") + j * period), F.transform(steps, lambda j: -1 - F.col("idx") + j * period))
    near = F.filter(at, lambda a: ((a >= 0) & (a == F.col("idx"))) | ((a < 0) & (a >= -k)) | ((a >= F.col("_n")) & (a < F.col("_n") + k)))
    inner = (F.col("idx") >= k) & (F.col("idx") < F.col("_n") - k)
    return rows.withColumn("_at", F.explode(F.when(inner, F.array(F.col("idx"))).otherwise(near))).withColumn("_own", (F.col("_at") >= 0) & (F.col("_at") < F.col("_n"))).drop("_n")


def median_filter(samples: DataFrame, width: int, out: str = "v") -> DataFrame:
    """Running median of an odd width with mirrored edges."""
    k = width // 2
    frame = by("_at").rowsBetween(-k, k)
    wide = mirrored(samples, k).withColumn("_m", median(F.col("v")).over(frame))
    return wide.where("_own").withColumn(out, F.col("_m")).drop("_at", "_own", "_m")


def windows_of(at: Column, size: int, stride: int, count: Column) -> Column:
    """Numbers of the sliding windows [k * stride, k * stride + size), k < count, that hold a place."""
    lo = F.greatest(F.lit(0), F.floor((at - size) / stride) + 1)
    hi = F.least(count - 1, F.floor(at / stride))
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))


def full_windows(n: Column, size: int, stride: int, closed_tail: bool = True) -> Column:
    """How many sliding windows fit in n places; without closed_tail one that ends exactly at n does not count."""
    fits = n - size if closed_tail else n - size - 1
    return F.when(fits < 0, F.lit(0).cast("long")).otherwise(F.floor(fits / stride) + 1)
