"""Signal quality of sliding windows of whole recordings, from panes that windows share.

A pane is a stride of samples and what the spectra that begin in it need beyond; samples are shuffled once, by recording and
pane, so that a recording is spread over as many tasks as it has panes. A pane gives its moments and the band powers of its
spectra, a few numbers, and windows add up the panes that they hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quality as Q
from .windows import KEY, full_windows

#: Bands in Hz, and the length of a spectrum's segment in seconds.
TOTAL, QRS, SEGMENT_S = (0.5, 40.0), (5.0, 20.0), 2.0
MOMENTS = ("n", "mean", "m2", "m3", "m4")


@dataclass(frozen=True)
class Grid:
    """Windows of `size` samples every `stride`, with spectra of `segment` samples every `step` from a window's start."""

    fs: float
    size: int
    stride: int
    segment: int
    step: int

    @staticmethod
    def of(fs: float, window_s: float = 10.0, stride_s: float = 5.0) -> Grid:
        size, stride = int(window_s * fs), int(stride_s * fs)
        segment = min(size, int(SEGMENT_S * fs))
        return Grid(fs, size, stride, segment, segment - segment // 2)

    @property
    def shared(self) -> bool:
        """Whether windows begin where panes do, and so do spectra; otherwise each window is a pane of its own."""
        return self.size % self.stride == 0 and self.stride % self.step == 0

    @property
    def pane(self) -> int:
        return self.stride if self.shared else self.size

    @property
    def reach(self) -> int:
        """Samples of a pane and beyond it."""
        return self.pane + (self.segment - self.step if self.shared else 0)

    @property
    def offsets(self) -> list[int]:
        """Where spectra begin in a pane."""
        return list(range(0, self.pane, self.step) if self.shared else range(0, self.size - self.segment + 1, self.step))


def band_weights(fs: float, segment: int) -> np.ndarray:
    """Rows total, qrs and noise: what the squared magnitude of each frequency adds to the trapezoids over the band, in a one-sided
    density of a Hann segment. Noise is the total band without the other, its gap bridged by one trapezoid."""
    f = np.arange(segment // 2 + 1) * fs / segment
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / segment)
    density = np.full(len(f), 2.0 / (fs * (hann**2).sum()))
    density[0] /= 2
    if segment % 2 == 0:
        density[-1] /= 2
    total = (f >= TOTAL[0]) & (f <= TOTAL[1])
    qrs = (f >= QRS[0]) & (f <= QRS[1])
    out = np.zeros((3, len(f)))
    for row, inside in zip(out, (total, qrs, total & ~qrs)):
        at = np.flatnonzero(inside)
        half = np.diff(f[at]) / 2
        row[at[:-1]] += half
        row[at[1:]] += half
    return out * density


def _measure(grid: Grid):
    """Moments and band powers of panes(rec_id, pane, idx, v); a spectrum that lacks a sample is left out."""
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(grid.segment) / grid.segment)
    weights = band_weights(grid.fs, grid.segment)
    offsets = np.array(grid.offsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pane, cells = batch.column("pane").to_numpy(), batch.column("xs")
            row = np.repeat(np.arange(batch.num_rows), np.diff(cells.offsets.to_numpy()))
            flat = cells.flatten()
            at = flat.field("idx").to_numpy() - pane[row] * grid.stride
            x = np.full((batch.num_rows, grid.reach), np.nan)
            x[row, at] = flat.field("v").to_numpy(zero_copy_only=False)
            own = x[:, : grid.pane]
            there = ~np.isnan(own)
            n = there.sum(axis=1)
            mean = np.divide(np.where(there, own, 0).sum(axis=1), n, out=np.zeros(len(n)), where=n > 0)
            d = np.where(there, own - mean[:, None], 0)
            moments = [n, mean, *(np.power(d, k).sum(axis=1) for k in (2, 3, 4))]
            segments = x[:, offsets[:, None] + np.arange(grid.segment)]
            power = np.abs(np.fft.rfft((segments - segments.mean(axis=2, keepdims=True)) * hann)) ** 2
            bands = power @ weights.T
            whole = ~np.isnan(bands).any(axis=2)
            values = bands[whole]
            ends = pa.array(np.concatenate([[0], np.cumsum(whole.sum(axis=1))]), pa.int32())
            begin = np.broadcast_to(offsets, whole.shape)[whole]
            structs = pa.StructArray.from_arrays([pa.array(begin, pa.int64()), *(pa.array(values[:, i]) for i in range(3))], ["at", "total", "qrs", "noise"])
            columns = [batch.column(KEY), batch.column("pane"), *(pa.array(m, pa.int64() if i == 0 else pa.float64()) for i, m in enumerate(moments)), pa.ListArray.from_arrays(ends, structs)]
            yield pa.RecordBatch.from_arrays(columns, [KEY, "pane", *MOMENTS, "spectra"])

    return run


def panes(samples: DataFrame, grid: Grid) -> DataFrame:
    """rec_id, pane, n, mean, m2, m3, m4 (sums of powers about the mean), spectra(at, total, qrs, noise) of samples(rec_id, idx, v)."""
    last = F.floor(F.col("idx") / grid.stride)
    first = F.greatest(F.lit(0), F.floor((F.col("idx") - grid.reach) / grid.stride) + 1)
    valid = samples.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    rows = valid.select(KEY, "idx", F.col("v").cast("double").alias("v"), F.explode(F.sequence(first, last)).alias("pane"))
    held = rows.groupBy(KEY, "pane").agg(F.collect_list(F.struct("idx", "v")).alias("xs"))
    kind = samples.schema[KEY].dataType.simpleString()
    return held.mapInArrow(_measure(grid), f"{KEY} {kind}, pane long, n long, mean double, m2 double, m3 double, m4 double, spectra array<struct<at: long, total: double, qrs: double, noise: double>>")


def _total(of: str | Column, what) -> Column:
    return F.aggregate(of, F.lit(0.0), lambda s, p: s + what(p))


def _about(k: int) -> Column:
    """Sum of powers about the mean of all panes of an array, from those about the mean of each."""
    d = lambda p: p["mean"] - F.col("mean")
    terms = {
        2: lambda p: p["m2"] + p["n"] * F.pow(d(p), 2),
        3: lambda p: p["m3"] + 3 * d(p) * p["m2"] + p["n"] * F.pow(d(p), 3),
        4: lambda p: p["m4"] + 4 * d(p) * p["m3"] + 6 * F.pow(d(p), 2) * p["m2"] + p["n"] * F.pow(d(p), 4),
    }
    return _total("panes", terms[k])


def window_sqi(samples: DataFrame, fs: float, window_s: float = 10.0, stride_s: float = 5.0) -> DataFrame:
    """rec_id, window_idx, start_sample, end_sample, start_ms, end_ms, center_ms, qrs_energy_ratio, snr_db, kurtosis, skewness, nk_sqi,
    score, quality_label, is_usable for each full window of samples(rec_id, idx, v), idx from 0 at fs samples a second.

    Powers are Welch's, over Hann segments of two seconds that overlap by half. nk_sqi is the quality that the kurtosis stands for. A
    window of equal samples has no shape; one that lacks a sample (no row, null, NaN or infinite) has no numbers, is poor and not
    usable. A recording shorter than a window has none.
    """
    grid = Grid.of(fs, window_s, stride_s)
    of_window = grid.size // grid.pane
    ends = samples.groupBy(KEY).agg(full_windows(F.max("idx") + 1, grid.size, grid.stride).alias("count"))
    all_ = ends.where("count > 0").select(KEY, F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("window_idx"))
    part = F.col("part")
    spectra = F.filter("spectra", lambda s: part * grid.pane + s["at"] + grid.segment <= grid.size)
    rows = panes(samples, grid).withColumn("part", F.explode(F.array(*[F.lit(i) for i in range(of_window)])))
    rows = rows.select(KEY, (F.col("pane") - part).alias("window_idx"), F.struct(*MOMENTS, spectra.alias("spectra")).alias("p"))
    w = rows.groupBy(KEY, "window_idx").agg(F.collect_list("p").alias("panes"), F.sum("p.n").alias("n")).where(F.col("n") == grid.size)
    w = w.withColumn("mean", _total("panes", lambda p: p["n"] * p["mean"]) / grid.size).withColumn("s", F.flatten("panes.spectra"))
    w = w.select(KEY, "window_idx", *[_about(k).alias(f"m{k}") for k in (2, 3, 4)], *[F.try_divide(_total("s", lambda x, b=b: x[b]), F.size("s")).alias(b) for b in ("total", "qrs", "noise")])
    shape = F.nullif(F.col("m2"), F.lit(0.0))
    w = w.select(
        KEY, "window_idx",
        F.coalesce(F.try_divide("qrs", "total"), F.lit(0.0)).alias("qrs_energy_ratio"),
        F.coalesce(10 * F.log10(F.try_divide("qrs", "noise")), F.lit(0.0)).alias("snr_db"),
        (F.try_divide(F.col("m4") * grid.size, shape * shape) - 3).alias("kurtosis"),
        F.try_divide(F.col("m3") * F.sqrt(F.lit(float(grid.size))), F.pow(shape, 1.5)).alias("skewness"),
    )
    w = w.withColumn("nk_sqi", Q.from_kurtosis(F.col("kurtosis")))
    w = w.withColumn("score", Q.composite(F.col("qrs_energy_ratio"), F.col("snr_db"), F.col("kurtosis"), F.col("nk_sqi")))
    label = F.when(F.col("score").isNull(), "poor").otherwise(Q.label(F.col("score")))
    got = all_.join(w, [KEY, "window_idx"], "left").withColumn("quality_label", label)
    start = F.col("window_idx") * grid.stride
    ms = lambda at: (at * (1000.0 / fs)).cast("long")
    times = {"start_sample": start, "end_sample": start + grid.size, "start_ms": ms(start), "end_ms": ms(start + grid.size - 1), "center_ms": ms(start + grid.size // 2)}
    return got.select(KEY, "window_idx", *[c.alias(n) for n, c in times.items()], "qrs_energy_ratio", "snr_db", "kurtosis", "skewness", "nk_sqi", "score", "quality_label", (F.col("quality_label") != "poor").alias("is_usable"))


def gated_windows(windows: DataFrame, beats: DataFrame, fs: float, window_s: float = 10.0, stride_s: float = 5.0, rr_s: tuple[float, float] = (0.24, 2.0)) -> DataFrame:
    """windows = window_sqi(...) with n_peaks, the beats(rec_id, peak_id, t_ms) of a usable window, and hr_bpm, the median rate over
    its intervals between two beats inside and strictly within rr_s; both 0 in a window that is not usable, hr_bpm also in
    one without such an interval."""
    from .windows import by, median, windows_of

    grid = Grid.of(fs, window_s, stride_s)
    size, stride = round(grid.size * 1000 / fs), round(grid.stride * 1000 / fs)
    count = windows.groupBy(KEY).agg((F.max("window_idx") + 1).alias("count"))
    rows = beats.select(KEY, "t_ms", F.lead("t_ms").over(by("t_ms", "peak_id")).alias("next")).join(count, KEY)
    rows = rows.select(KEY, "t_ms", "next", F.explode(windows_of(F.col("t_ms"), size, stride, F.col("count"))).alias("window_idx"))
    usable = windows.where("is_usable").select(KEY, "window_idx")
    rr = (F.col("next") - F.col("t_ms")) / 1000
    inside = (F.col("next") < F.col("window_idx") * stride + size) & (rr > rr_s[0]) & (rr < rr_s[1])
    hr = rows.join(usable, [KEY, "window_idx"]).groupBy(KEY, "window_idx").agg(F.count("*").alias("n_peaks"), median(F.when(inside, F.try_divide(F.lit(60), rr))).alias("hr_bpm"))
    got = windows.join(hr, [KEY, "window_idx"], "left")
    return got.withColumns({"n_peaks": F.coalesce("n_peaks", F.lit(0)).cast("long"), "hr_bpm": F.coalesce("hr_bpm", F.lit(0.0))})
