"""Filters and beat detectors over signals(rec_id, fs, x): Spark deals the rows, NumPy works on a batch of equal length.

A row is a recording or a frame of one; long recordings are cut into frames with a halo (frame() does so), which keeps
a row small whatever the recording's length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters as fl, thresholds as th
from .windows import KEY, sliced

#: Signals whose samples a task holds as Python objects at once.
ROWS = 256

Kernel = Callable[[np.ndarray, float], np.ndarray]


def frame(samples: DataFrame, fs: float, size: int, halo: int) -> DataFrame:
    """signals with frame_idx and start_idx: frames of `size` samples and `halo` more on either side, from
    samples(rec_id, idx, v). Each sample goes to the frames that need it; a frame is gathered and sorted alone."""
    lo = F.greatest(F.lit(0), F.floor((F.col("idx") - halo) / size))
    near = F.explode(F.sequence(lo, F.floor((F.col("idx") + halo) / size)))
    rows = samples.withColumn("frame_idx", near).groupBy(KEY, "frame_idx").agg(F.sort_array(F.collect_list(F.struct("idx", "v"))).alias("s"))
    # frames that begin beyond the last sample hold halo only
    own = F.exists("s", lambda p: F.floor(p["idx"] / size) == F.col("frame_idx"))
    return rows.where(own).select(KEY, "frame_idx", F.lit(float(fs)).alias("fs"), F.col("s")[0]["idx"].alias("start_idx"), F.transform("s", lambda p: p["v"]).alias("x"))


def filtered(signals: DataFrame, kernel: Kernel) -> DataFrame:
    """signals with x replaced by kernel(rows, fs). A null or empty signal stays; nulls inside count as zero."""
    names = signals.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if x is None else list(x) for x in batch.column(names.index("x")).to_pylist()]
            rates = batch.column(names.index("fs")).to_pylist()
            for (_, fs), rows in _alike(out, rates).items():
                done = kernel(np.array([[0.0 if v is None else v for v in out[i]] for i in rows]), fs)
                for i, y in zip(rows, done):
                    out[i] = y
            columns = [pa.array(out, pa.list_(pa.float64())) if c == "x" else batch.column(k) for k, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return signals.mapInArrow(run, signals.schema)


def bandpass(low: float = 0.5, high: float = 40.0, order: int = 4) -> Kernel:
    return lambda x, fs: fl.bandpass(x, fs, low, high, order)


def notch(f: float = 60.0, q: float = 30.0) -> Kernel:
    """No filter at or above 0.9 of the Nyquist frequency."""
    return lambda x, fs: x if f >= 0.9 * fs / 2 else fl.zero_phase(fl.notch(f, q, fs), x)


def notch_comb(f: float = 50.0, q: float = 30.0) -> Kernel:
    def run(x: np.ndarray, fs: float) -> np.ndarray:
        for k in range(1, int(fs / 2 / f) + 1):
            x = fl.zero_phase(fl.notch(k * f, q, fs), x) if k * f < fs / 2 else x
        return x

    return run


def ecg_filter(low: float = 0.5, high: float = 40.0, mains: float = 50.0, order: int = 2) -> Kernel:
    """Invalid samples filled, high-pass, notches at the mains frequency and its multiples, low-pass."""
    return lambda x, fs: fl.single(notch_comb(mains)(fl.single(fl.filled(x), fs, order, low=low), fs), fs, order, high=high)


def ppg_filter(low: float = 0.5, high: float = 8.0, order: int = 4, spike: int = 5, line: bool = True, score: bool = True) -> Kernel:
    """Invalid samples filled, spikes out by a running median (0: not), line removed, band-pass, z-score unless the signal is flat."""

    def run(x: np.ndarray, fs: float) -> np.ndarray:
        x = fl.filled(x)
        x = fl.running_median(x, spike) if spike else x
        x = fl.bandpass(fl.detrended(x) if line else x, fs, low, high, order)
        spread = x.std(axis=1, keepdims=True)
        return np.where(spread > 1e-6, (x - x.mean(axis=1, keepdims=True)) / np.maximum(spread, 1e-6), x) if score else x

    return run


#: The variant with a narrower, steeper band and a wider median.
ROBUST_PPG = {"low": 0.8, "high": 5.0, "order": 6, "spike": 9}


def resampled(kernel: Kernel, rate: float) -> Kernel:
    """The kernel after resampling to another rate."""
    return lambda x, fs: kernel(fl.resample_ratio(x, int(round(rate)), int(round(fs))), rate)


def pipeline_standard(x: np.ndarray, fs: float) -> np.ndarray:
    """Notch, band-pass, baseline."""
    return fl.baseline_removed(bandpass()(notch()(x, fs), fs), fs)


def pipeline_band(x: np.ndarray, fs: float) -> np.ndarray:
    """The standard pipeline, then a band of 5 to 40 Hz by a filter."""
    return fl.bandpass(pipeline_standard(x, fs), fs, 5.0, 40.0)


def pipeline_wavelet(x: np.ndarray, fs: float) -> np.ndarray:
    """The standard pipeline, then that band by wavelets of its frequencies."""
    return fl.morlet_band(pipeline_standard(x, fs), fs, 5.0, min(40.0, 0.49 * fs))


PIPELINES: dict[str, Kernel] = {"A": pipeline_standard, "B": pipeline_band, "C": pipeline_wavelet}


@dataclass(frozen=True)
class Preprocess:
    """Steps of preprocessed(); None or False leaves one out. wavelet: "denoise" or "band"."""

    notch: float | None = 60.0
    band: tuple[float, float] | None = (0.5, 40.0)
    baseline: bool = True
    wavelet: str | None = None
    auto_invert: bool = True
    skew: float = -0.1


def _prepared(x: np.ndarray, fs: float, how: Preprocess) -> tuple[np.ndarray, list[list[str]]]:
    invalid = ~np.isfinite(x).all(axis=1)
    x, steps = fl.filled(x), []
    if how.notch:
        x, steps = notch(how.notch)(x, fs), [*steps, f"notch_{how.notch:g}Hz"]
    if how.band:
        x, steps = bandpass(*how.band)(x, fs), [*steps, "bandpass_{:g}-{:g}Hz".format(*how.band)]
    if how.baseline:
        x, steps = fl.baseline_removed(x, fs), [*steps, "baseline_removal"]
    if how.wavelet:
        x, steps = (fl.denoise(x) if how.wavelet == "denoise" else fl.morlet_band(x, fs, 5.0, min(40.0, 0.49 * fs))), [*steps, f"wavelet_{how.wavelet}"]
    said = [["interpolate_invalid"] * bool(bad) + steps for bad in invalid]
    if how.auto_invert:
        c = x - x.mean(axis=1, keepdims=True)
        down = (c**3).mean(axis=1) < how.skew * np.maximum((c**2).mean(axis=1), 1e-300) ** 1.5
        x = np.where(down[:, None], -x, x)
        said = [own + ["auto_inverted"] * bool(d) for own, d in zip(said, down)]
    return x, said


def preprocessed(signals: DataFrame, how: Preprocess = Preprocess()) -> DataFrame:
    """signals with x after the steps, steps (their names) and inverted. Null and non-finite samples are filled; a null or empty
    signal stays and has no steps."""
    names = signals.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, rates = batch.column(names.index("x")).to_pylist(), batch.column(names.index("fs")).to_pylist()
            out, steps = list(rows), [[] for _ in rows]
            for (_, fs), own in _alike(rows, rates).items():
                done, said = _prepared(np.array([[np.nan if v is None else v for v in rows[i]] for i in own]), fs, how)
                for i, y, t in zip(own, done, said):
                    out[i], steps[i] = y, t
            columns = [pa.array(out, pa.list_(pa.float64())) if c == "x" else batch.column(k) for k, c in enumerate(names)]
            flipped = pa.array(["auto_inverted" in t for t in steps])
            yield pa.RecordBatch.from_arrays([*columns, pa.array(steps, pa.list_(pa.string())), flipped], [*names, "steps", "inverted"])

    schema = ", ".join(f"`{n}` {t}" for n, t in signals.dtypes)
    return signals.mapInArrow(run, f"{schema}, steps array<string>, inverted boolean")


def front_end(kernel: Callable, spread: float = 1.5) -> Callable:
    """A detector whose peaks are kept within so many standard deviations of their median height, where there are three."""

    def run(x: np.ndarray, fs: float) -> list[list[int]]:
        out = []
        for row, peaks in zip(x, kernel(x, fs)):
            at = np.array(peaks, int)
            if len(at) >= 3:
                at = at[np.abs(row[at] - np.median(row[at])) <= spread * row[at].std()]
            out.append(at.tolist())
        return out

    return run


def _alike(rows: list, rates: list) -> dict[tuple, list[int]]:
    """Rows that are neither null nor empty, by length and rate."""
    groups: dict[tuple, list[int]] = {}
    for i, x in enumerate(rows):
        if x:
            groups.setdefault((len(x), rates[i]), []).append(i)
    return groups


def _mean(x: np.ndarray, n: int) -> np.ndarray:
    """Average over the n samples up to each one."""
    n = max(1, n)
    c = np.cumsum(np.concatenate([np.zeros((len(x), 1)), x], axis=1), axis=1)
    at = np.arange(1, x.shape[1] + 1)
    return (c[:, at] - c[:, np.maximum(0, at - n)]) / np.minimum(at, n)


def _each(rows: np.ndarray, fs: float, pick) -> list[list[int]]:
    return [list(map(int, pick(r, fs))) for r in rows]


def pan_tompkins(x: np.ndarray, fs: float) -> list[list[int]]:
    y = fl.run(fl.butter(1, 5, 15, fs), x)
    return _each(_mean(np.diff(y, axis=1, prepend=y[:, :1]) ** 2, int(0.12 * fs)), fs, th.levels)


def integrated(x: np.ndarray, fs: float) -> np.ndarray:
    """Zero-phase band, five-point derivative, square, mean over 150 ms."""
    y = fl.bandpass(x, fs, 5, 15, 2)
    d = np.stack([np.convolve(r, np.array([1, 2, 0, -2, -1]) * fs / 8, "same") for r in y])
    w = max(1, int(0.15 * fs))
    return np.stack([np.convolve(r, np.ones(w) / w, "same") for r in d * d])


def pan_tompkins_full(x: np.ndarray, fs: float) -> list[list[int]]:
    """Beats of the integrated signal, each moved to the largest sample near it."""
    reach = max(1, int(0.05 * fs))
    near = lambda r, p: max(0, p - reach) + int(np.abs(r[max(0, p - reach) : p + reach]).argmax())
    return [[near(r, p) for p in peaks] for r, peaks in zip(x, _each(integrated(x, fs), fs, th.signal_and_noise))]


def hamilton(x: np.ndarray, fs: float) -> list[list[int]]:
    y = fl.run(fl.butter(1, 8, 16, fs), x)
    return _each(_mean(np.abs(np.diff(y, axis=1, prepend=y[:, :1])), int(0.08 * fs)), fs, th.recent_means)


def christov(x: np.ndarray, fs: float) -> list[list[int]]:
    """Mean over 20 ms, over 28 ms, of the slope over 40 ms, less what these reach over at the start."""
    widths = [max(1, int(w * fs)) for w in (0.02, 0.028, 0.04)]
    y = _mean(_mean(x, widths[0]), widths[1])
    m = _mean(np.abs(y[:, 2:] - y[:, :-2]), widths[2])
    m[:, : sum(widths)] = 0
    return _each(m, fs, th.steep_slope)


def engzee(x: np.ndarray, fs: float) -> list[list[int]]:
    """Mains out, difference over four samples, binomial low-pass, silent for the first 200 ms."""
    y = fl.run(fl.notch(50, 12.5, fs), x) if 52 < fs / 2 else x
    d = np.zeros_like(y)
    d[:, 4:] = y[:, 4:] - y[:, :-4]
    low = np.stack([np.convolve(r, [1, 4, 6, 4, 1])[: len(r)] for r in d])
    low[:, : int(0.2 * fs)] = 0
    return [th.rise_and_fall(m, r, fs) for m, r in zip(low, x)]


def two_average(x: np.ndarray, fs: float) -> list[list[int]]:
    y = np.abs(fl.run(fl.butter(2, 8, min(20, 0.49 * fs), fs), x))
    short, long = _mean(y, int(0.12 * fs)), _mean(y, int(0.6 * fs))
    return [th.blocks(a, b, r, fs) for a, b, r in zip(short, long, y)]


def matched_filter(template: np.ndarray | None = None) -> Callable:
    """Correlation with a template, or with a narrow wave where none is given."""

    def run(x: np.ndarray, fs: float) -> list[list[int]]:
        own = template
        if own is None:
            t = np.linspace(-2, 2, max(3, int(0.12 * fs)))
            own = (1 - t * t) * np.exp(-t * t / 2)
        y = fl.run(fl.butter(4, 0.1, min(48, 0.49 * fs), fs), x)
        m = np.stack([np.convolve(r, own[::-1], "same") for r in y])
        return _each(m * m, fs, th.levels)

    return run


def wavelet(x: np.ndarray, fs: float) -> list[list[int]]:
    detail = fl.stationary_details(x, fl.DB3, 3)[2]
    return _each(_mean(detail * detail, int(0.12 * fs)), fs, th.levels)


def pulse_beats(x: np.ndarray, fs: float) -> list[list[int]]:
    """Pulses as maxima over all scales, in windows of 6 s at about 20 Hz, moved to the largest sample within 50 ms."""
    factor = max(1, int(fs // 20))
    size, out = int(6 * fs), []
    for r in x:
        found = set()
        starts = [*range(0, max(1, len(r) - size + 1), max(1, int(size * 0.8))), max(0, len(r) - size)]
        for s in starts:
            part = r[s : s + size]
            t = np.arange(len(part)) - (len(part) - 1) / 2
            part = part - part.mean() - t * (part @ t) / max((t * t).sum(), 1e-12)
            reach = max(1, int(0.05 * fs))
            for p in th.scalogram_maxima(part[::factor], fs / factor) * factor:
                lo = max(0, s + p - reach)
                found.add(lo + int(r[lo : s + p + reach + 1].argmax()))
        out.append(sorted(found))
    return out


#: What can be asked for by name. Names bound to None stand for outside models that a user may register.
REGISTRY: dict[str, Callable | None] = {
    "pan_tompkins": pan_tompkins, "pan_tompkins_full": pan_tompkins_full, "hamilton": hamilton, "christov": christov, "engzee": engzee,
    "two_average": two_average, "matched_filter": matched_filter(), "wavelet": wavelet, "pulse": pulse_beats,
    "deep_model": None, "library_default": None,
}


def _detected(rows: list, rates: list, kernel: Callable) -> list[tuple[list[int], str | None]]:
    """Peaks and error of each row. Rows of one length and rate go together; if that fails, each is tried alone."""
    out: list[tuple[list[int], str | None]] = [([], "ValueError: no samples")] * len(rows)
    for (_, fs), own in _alike(rows, rates).items():
        block = np.array([[0.0 if v is None else v for v in rows[i]] for i in own])
        try:
            found = [(p, None) for p in kernel(block, fs)]
        except Exception:  # noqa: BLE001  which row it was shows below
            found = []
            for x in block:
                try:
                    found.append((kernel(x[None, :], fs)[0], None))
                except Exception as e:  # noqa: BLE001  one signal's failure is a row's text
                    found.append(([], f"{type(e).__name__}: {e}"))
        for i, f in zip(own, found):
            out[i] = f
    return out


def detect_all(signals: DataFrame, methods: dict[str, Callable]) -> DataFrame:
    """rec_id, detector, peaks (array of sample numbers), error for every row of signals(rec_id, fs, x) and every method, from
    one pass over the signals. A signal that a detector fails on, or that is null or empty, has no peaks and the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ROWS):
            rows, rates = batch.column("x").to_pylist(), batch.column("fs").to_pylist()
            for name, kernel in methods.items():
                peaks, errors = zip(*_detected(rows, rates, kernel)) if rows else ((), ())
                yield pa.RecordBatch.from_arrays([batch.column(KEY), pa.array([name] * len(rows), pa.string()), pa.array(peaks, pa.list_(pa.int64())), pa.array(errors, pa.string())], [KEY, "detector", "peaks", "error"])

    kind = dict(signals.dtypes)[KEY]
    return signals.select(KEY, "fs", "x").mapInArrow(run, f"{KEY} {kind}, detector string, peaks array<bigint>, error string")


def detect(signals: DataFrame, method: str, kernel: Callable | None = None) -> DataFrame:
    """detect_all() with one method of the registry, or with a kernel of the caller's under that name."""
    chosen = kernel or REGISTRY[method]
    if chosen is None:
        raise ValueError(f"{method} needs a model of yours: pass it as kernel(rows, fs)")
    return detect_all(signals, {method: chosen})


class DetectBeats:
    """Rows of detect_beats(fs, x, method), a table function for SQL: peak_idx of every beat of one signal."""

    def eval(self, fs: float, x: list[float], method: str) -> Iterator[tuple[int]]:
        kernel = REGISTRY[method]
        if kernel is None:
            raise ValueError(f"{method} needs a model of yours")
        if x:
            yield from ((int(p),) for p in kernel(np.array([[0.0 if v is None else v for v in x]]), float(fs))[0])


def register_functions(spark: SparkSession) -> None:
    """Make detect_beats known to SQL: SELECT ... FROM signals, LATERAL detect_beats(fs, x, 'hamilton')."""
    spark.udtf.register("detect_beats", F.udtf(DetectBeats, returnType="peak_idx long"))
