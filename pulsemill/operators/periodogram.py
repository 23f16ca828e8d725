"""Lomb-Scargle periodograms of uneven series, on grids of a thousand frequencies.

A series is cut by time. Sums of points with complex exponentials add up over cuts, and no row is made for a point and a
frequency: the exponentials of a grid are outer products of a coarse and a fine one, so that a point takes a few dozen of
them and a multiplication for each frequency.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import KEY

#: Windows that a task works on together, at most points whose exponentials it holds, and frequencies between coarse ones.
BLOCK, POINTS, FINE = 64, 256, 32


@dataclass(frozen=True)
class Frequencies:
    """n of them, from start by step, in Hz."""

    start: float
    step: float
    n: int

    @property
    def f(self) -> np.ndarray:
        return self.start + np.arange(self.n) * self.step


def exponentials(t: np.ndarray, freqs: Frequencies) -> np.ndarray:
    """exp(2 pi i f t), a row for each t."""
    fine = np.exp(2j * np.pi * freqs.step * np.outer(t, np.arange(FINE)))
    coarse = np.exp(2j * np.pi * np.outer(t, freqs.start + freqs.step * FINE * np.arange(-(-freqs.n // FINE))))
    return (coarse[:, :, None] * fine[:, None, :]).reshape(len(t), FINE * coarse.shape[1])[:, : freqs.n]


def sums(t: np.ndarray, y: np.ndarray, freqs: Frequencies) -> np.ndarray:
    """Rows 1, y (in their first place), and the sums of e, y e and e * e with the exponentials e."""
    out = np.zeros((4, freqs.n + 1), complex)
    out[0, 0], out[1, 0] = len(t), y.sum()
    for lo in range(0, len(t), POINTS):
        e, own = exponentials(t[lo : lo + POINTS], freqs), y[lo : lo + POINTS]
        out[1, 1:] += e.sum(axis=0)
        out[2, 1:] += own @ e
        out[3, 1:] += np.einsum("ij,ij->j", e, e)
    return out


def power(total: np.ndarray, floating: bool = False) -> np.ndarray:
    """The periodogram of y less its mean, from sums(...) (..., 4, n + 1); floating: with a constant fitted at every frequency besides.
    Not normalised by the variance of y."""
    n, mean = total[..., 0, :1].real, total[..., 1, :1].real / total[..., 0, :1].real
    e, ye, ee = (total[..., k, 1:] for k in (1, 2, 3))
    c, s = e.real, e.imag
    yc, ys = ye.real - mean * c, ye.imag - mean * s
    cc, cs = (n + ee.real) / 2, ee.imag / 2
    ss = n - cc
    if floating:
        cc, cs, ss = cc - c * c / n, cs - c * s / n, ss - s * s / n
    tau = np.arctan2(2 * cs, cc - ss) / 2
    ct, st = np.cos(tau), np.sin(tau)
    return ((yc * ct + ys * st) ** 2 / (cc * ct**2 + 2 * cs * ct * st + ss * st**2) + (ys * ct - yc * st) ** 2 / (cc * st**2 - 2 * cs * ct * st + ss * ct**2)) / 2


def trapezoids(f: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Weights of the area between neighbouring frequencies of a band."""
    out = np.zeros(len(f))
    at = np.flatnonzero(inside)
    half = np.diff(f[at]) / 2
    out[at[:-1]] += half
    out[at[1:]] += half
    return out


def window_bands(points: DataFrame, freqs: Frequencies, size: int, stride: int, least: int, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """rec_id, win and the area of the periodogram over each of bands (f >= lo and f < hi), for the windows [win * stride, win * stride +
    size) of points(rec_id, t_ms from 0, y, count) that hold over `least` points; count is the number of windows of the recording.
    size is a multiple of stride.

    Points are shuffled once, by recording and block of windows, and a block sums its panes of one stride once each.
    """
    panes = size // stride
    pane = F.floor(F.col("t_ms") / stride)
    first, last = F.greatest(F.lit(0), F.floor((pane - panes + 1) / BLOCK)), F.least(F.floor(pane / BLOCK), F.floor((F.col("count") - 1) / BLOCK))
    near = F.when((F.col("count") > 0) & (first <= last), F.sequence(first, last))
    held = points.withColumn("block", F.explode(near)).groupBy(KEY, "block").agg(F.max("count").alias("count"), F.collect_list(F.struct("t_ms", "y")).alias("xs"))
    weights = np.array([trapezoids(freqs.f, (freqs.f >= lo) & (freqs.f < hi)) for lo, hi in bands.values()])

    def of_block(block: int, count: int, t: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = block * BLOCK
        own = t // stride - begin
        total = np.zeros((BLOCK + panes - 1, 4, freqs.n + 1), complex)
        for p in np.unique(own):
            at = own == p
            total[p] = sums((t[at] - begin * stride) / 1000, y[at], freqs)
        whole = np.array([total[w : w + panes].sum(axis=0) for w in range(min(BLOCK, count - begin))])
        full = np.flatnonzero(whole[:, 0, 0].real > least)
        return begin + full, power(whole[full]) @ weights.T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                xs = batch.column("xs")[i].values
                win, areas = of_block(batch.column("block")[i].as_py(), batch.column("count")[i].as_py(), xs.field("t_ms").to_numpy(), xs.field("y").to_numpy())
                rec = pa.array([batch.column(KEY)[i].as_py()] * len(win), batch.schema.field(KEY).type)
                yield pa.RecordBatch.from_arrays([rec, pa.array(win, pa.int64()), *(pa.array(a) for a in areas.T.copy())], [KEY, "win", *bands])

    return held.mapInArrow(run, f"{KEY} {points.schema[KEY].dataType.simpleString()}, win long, " + ", ".join(f"{b} double" for b in bands))


def whole_power(points: DataFrame, freqs: Frequencies, chunk_ms: int, floating: bool = False) -> DataFrame:
    """rec_id, power: an array with the periodogram at each frequency, of all points(rec_id, t_ms, y) of a recording. Chunks of time are
    summed by themselves, and a recording's sums are added up as they stream in."""
    kind = points.schema[KEY].dataType.simpleString()
    held = points.groupBy(KEY, F.floor(F.col("t_ms") / chunk_ms).alias("chunk")).agg(F.collect_list(F.struct("t_ms", "y")).alias("xs"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                xs = batch.column("xs")[i].values
                found.append(sums(xs.field("t_ms").to_numpy() / 1000, xs.field("y").to_numpy(), freqs).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(KEY), batch.column("chunk"), pa.array(found, pa.binary())], [KEY, "chunk", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], rec_type), pa.array([power(total, floating)], pa.list_(pa.float64()))], [KEY, "power"])

        now, total, rec_type = None, None, None
        for batch in batches:
            rec_type = batch.schema.field(KEY).type
            for rec, data in zip(batch.column(KEY).to_pylist(), batch.column("data").to_pylist()):
                own = np.frombuffer(data, complex).reshape(4, freqs.n + 1)
                if total is not None and rec != now:
                    yield made()
                    total = None
                now, total = rec, own.copy() if total is None else total + own
        if total is not None:
            yield made()

    parts = held.mapInArrow(part, f"{KEY} {kind}, chunk long, data binary")
    return parts.repartition(KEY).sortWithinPartitions(KEY, "chunk").mapInArrow(add, f"{KEY} {kind}, power array<double>")
