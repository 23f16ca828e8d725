"""Noise as recorded noise is: a linear predictor and the density of what it leaves, fitted once for all records of a kind, and test
windows with what is true of them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import KEY, by, sliced

ORDER = 3
#: Windows that a task works on at once.
ROWS = 256
#: Places of the inverse distribution of residues.
TABLE = 512
#: Fixed values of the test windows: peak-to-peak in mV, waves of the baseline with their frequencies in Hz and amplitudes as a share of
#: the signal's, and the distance at which the truth map is clipped.
PEAK_TO_PEAK, WAVES, WAVE_HZ, WAVE_SHARE, CLIP = (0.0001, 0.005), (3, 7), (0.01, 0.80), (0.05, 0.40), 50.0


def levinson(r: np.ndarray) -> np.ndarray:
    """Coefficients a of the predictor sum(a[k] * x[i - 1 - k]) from the autocorrelations r[0], r[1], ...; zeros for silence."""
    a, error = np.zeros(len(r) - 1), float(r[0])
    for m in range(len(a)):
        if error <= 0:
            break
        k = (r[m + 1] - a[:m] @ r[m:0:-1]) / error
        a[:m], a[m] = a[:m] - k * a[:m][::-1], k
        error *= 1 - k * k
    return a


def _lags(noise: DataFrame, order: Sequence[str]) -> DataFrame:
    w = by(*order)
    return noise.withColumns({f"_l{k}": F.when(F.lag("idx", k).over(w) == F.col("idx") - k, F.lag("v", k).over(w)) for k in range(1, ORDER + 1)})


def predictors(noise: DataFrame, order: Sequence[str] = ("idx",)) -> DataFrame:
    """kind, n, a (coefficients) for each kind of noise(rec_id, kind, idx, v). Products of neighbours are summed up over all records of a
    kind, and no record is held whole; rows that are not a number are left out, and what follows a gap has no neighbour. order: columns that put
    a record in the order of idx, where it is sorted by them already."""
    rows = _lags(noise.where(F.col("v").isNotNull() & ~F.isnan("v")), order)
    sums = rows.groupBy("kind").agg(F.count("*").alias("n"), F.array(F.sum(F.col("v") * F.col("v")), *[F.coalesce(F.sum(F.col("v") * F.col(f"_l{k}")), F.lit(0.0)) for k in range(1, ORDER + 1)]).alias("r"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = [levinson(np.array(r)).tolist() for r in b.column("r").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("n"), pa.array(a, pa.list_(pa.float64()))], ["kind", "n", "a"])

    return sums.mapInArrow(solve, f"kind {noise.schema['kind'].dataType.simpleString()}, n long, a array<double>")


def fit(noise: DataFrame, order: Sequence[str] = ("idx",)) -> DataFrame:
    """predictors(noise) with width (of the kernel, Scott's rule) and residues (TABLE values of the inverse distribution, by a sketch of
    bounded size)."""
    models = predictors(noise, order)
    left = F.col("v")
    for k in range(1, ORDER + 1):
        left = left - F.col("a")[k - 1] * F.col(f"_l{k}")
    residues = _lags(noise.where(F.col("v").isNotNull() & ~F.isnan("v")), order).join(F.broadcast(models), "kind").select("kind", "n", "a", left.alias("e")).where("e is not null")
    places = [(i + 0.5) / TABLE for i in range(TABLE)]
    return residues.groupBy("kind", "n", "a").agg((F.stddev_pop("e") * F.pow(F.count("*"), F.lit(-0.2))).alias("width"), F.percentile_approx("e", places, 10_000).alias("residues"))


def draw(rng: np.random.Generator, n: int, a: np.ndarray, residues: np.ndarray, width: float, before: int = 200) -> np.ndarray:
    """n samples of noise: residues drawn from the density and run through the predictor, after `before` samples that are dropped."""
    e = np.interp(rng.uniform(0, 1, n + before), (np.arange(len(residues)) + 0.5) / len(residues), residues) + width * rng.normal(size=n + before)
    out = np.zeros(n + before + len(a))
    for i in range(n + before):
        out[i + len(a)] = e[i] + a @ out[i : i + len(a)][::-1]
    return out[-n:] if n else out[:0]


def scaled_to(x: np.ndarray, noise: np.ndarray, snr_db: float) -> np.ndarray:
    """noise with a power snr_db below that of x; as it is where one of them is silent."""
    have, want = float((noise**2).mean()), float((x**2).mean()) / 10 ** (snr_db / 10)
    return noise * np.sqrt(want / have) if have > 0 and want > 0 else noise


def _rng(seed: int, key: object) -> np.random.Generator:
    import zlib

    return np.random.default_rng([seed, zlib.crc32(repr(key).encode())])


def with_noise(windows: DataFrame, models: DataFrame, snr_db: Column | float, seed: int = 42) -> DataFrame:
    """rec_id, kind, snr_db, noisy for windows(rec_id, kind, x): x with noise of its kind at a ratio of signal to noise. What is drawn
    depends on rec_id and seed alone. models, a row for each kind of a few kB, is broadcast: dealt by kind, all windows
    of a kind would meet in one task."""
    ready = windows.repartition(KEY).join(F.broadcast(models), "kind").select(KEY, "kind", F.lit(snr_db).cast("double").alias("snr_db") if not isinstance(snr_db, Column) else snr_db.cast("double").alias("snr_db"), "x", "a", "width", "residues")
    kinds = {f.name: f.dataType.simpleString() for f in ready.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, ROWS):
            out = []
            for rec, snr, x, a, width, residues in zip(*(b.column(c).to_pylist() for c in (KEY, "snr_db", "x", "a", "width", "residues"))):
                x = np.array(x, float)
                noise = draw(_rng(seed, rec), len(x), np.array(a), np.array(residues), width)
                out.append((x + scaled_to(x, noise, snr)).tolist() if len(x) else [])
            yield pa.RecordBatch.from_arrays([b.column(KEY), b.column("kind"), b.column("snr_db"), pa.array(out, pa.list_(pa.float64()))], [KEY, "kind", "snr_db", "noisy"])

    return ready.mapInArrow(run, f"{KEY} {kinds[KEY]}, kind {kinds['kind']}, snr_db double, noisy array<double>")


def truth_map(n: int, peaks: np.ndarray) -> np.ndarray:
    """Distance of each of n places to the nearest peak, clipped."""
    if not len(peaks):
        return np.full(n, CLIP)
    return np.minimum(CLIP, np.abs(np.arange(n)[:, None] - np.asarray(peaks)[None, :]).min(axis=1)).astype(float)


def weak_lead_windows(windows: DataFrame, fs: float, snr_db: tuple[float, float] = (10.0, 24.0), seed: int = 42) -> DataFrame:
    """rec_id, clean, noisy, truth, peak_to_peak, snr_db for windows(rec_id, x, peaks): x at the amplitude of a weak lead, with a wandering
    baseline of a few waves and white noise at a ratio drawn from snr_db; truth is the truth_map() of the peaks."""
    kind = windows.schema[KEY].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, ROWS):
            rows = []
            for rec, x, peaks in zip(*(b.column(c).to_pylist() for c in (KEY, "x", "peaks"))):
                rng, x = _rng(seed, rec), np.array(x, float)
                high = rng.uniform(*PEAK_TO_PEAK)
                clean = x * (high / max(float(np.ptp(x)), 1e-6)) if len(x) else x
                t = np.arange(len(x)) / fs
                base = sum((rng.uniform(*WAVE_SHARE) * high * np.sin(2 * np.pi * rng.uniform(*WAVE_HZ) * t + rng.uniform(0, 2 * np.pi)) for _ in range(rng.integers(*WAVES))), np.zeros(len(x)))
                snr = rng.uniform(*snr_db)
                noise = scaled_to(clean, rng.normal(size=len(x)), snr) if len(x) else x
                rows.append((rec, clean.tolist(), (clean + base + noise).tolist(), truth_map(len(x), np.array(peaks or [])).tolist(), high, snr))
            columns = list(zip(*rows)) if rows else [[]] * 6
            lists = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (b.schema.field(KEY).type, lists, lists, lists, pa.float64(), pa.float64()))], [KEY, "clean", "noisy", "truth", "peak_to_peak", "snr_db"])

    return windows.mapInArrow(run, f"{KEY} {kind}, clean array<double>, noisy array<double>, truth array<double>, peak_to_peak double, snr_db double")
