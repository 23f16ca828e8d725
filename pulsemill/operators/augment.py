"""Seeded noise for training signals. What a row gets depends on the seed and its rec_id, not on where it runs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import filters as fl
from .windows import KEY


def _sd(x: np.ndarray) -> float:
    return float(x.std()) or 1.0


def rescaled(rng, x, fs):
    return x * rng.uniform(0.7, 1.4)


def arm_scaled(rng, x, fs):
    return x * rng.uniform(0.07, 0.5)


def convolved(rng, x, fs):
    k = rng.normal(size=int(rng.choice([3, 5, 7])))
    return np.convolve(x, k / np.abs(k).sum(), "same")


def morphed(rng, x, fs):
    t = np.arange(len(x)) / fs
    return x + sum(rng.uniform(0.01, 0.05) * _sd(x) * np.sin(2 * np.pi * rng.uniform(1, 8) * t + rng.uniform(0, 6.28)) for _ in range(3))


def wandering(rng, x, fs):
    t, mad = np.arange(len(x)) / fs, float(np.median(np.abs(x - np.median(x)))) or 1.0
    return x + sum(rng.uniform(0.2, 1.0) * mad * np.sin(2 * np.pi * rng.uniform(0.05, 0.5) * t + rng.uniform(0, 6.28)) for _ in range(3))


def muscular(rng, x, fs):
    noise = fl.bandpass(rng.normal(size=(1, len(x))), fs, min(20, 0.2 * fs), 0.45 * fs, 2)[0]
    n = max(2, int(rng.uniform(0.1, 0.5) * len(x)))
    s = int(rng.integers(0, len(x) - n + 1))
    burst = np.zeros(len(x))
    burst[s : s + n] = np.minimum(1, np.minimum(np.arange(n), np.arange(n)[::-1]) / max(1, n // 4))
    return x + rng.uniform(0.1, 0.6) * _sd(x) * noise / max(noise.std(), 1e-12) * burst


def stepped(rng, x, fs):
    y = x.copy()
    for s in rng.integers(0, len(x), rng.poisson(1.0)):
        y[s:] += rng.laplace(0, _sd(x)) * np.exp(-np.arange(len(x) - s) / (rng.uniform(0.1, 1.0) * fs))
    return y


def clipped(rng, x, fs):
    bar = rng.uniform(1.5, 2.5) * _sd(x)
    return np.clip(x, x.mean() - bar, x.mean() + bar)


def gained(rng, x, fs):
    e = np.zeros(len(x))
    for i, z in enumerate(rng.normal(size=len(x))):
        e[i] = 0.95 * (e[i - 1] if i else 0.0) + 0.05 * z
    return x * (1 + e)


def mains(rng, x, fs):
    t = np.arange(len(x)) / fs
    phase = np.cumsum(rng.normal(size=len(x)) * 0.01)
    f = min(float(rng.choice([50, 60])), 0.45 * fs)
    return x + rng.uniform(0.05, 0.3) * _sd(x) * (1 + 0.3 * np.sin(2 * np.pi * 0.3 * t)) * np.sin(2 * np.pi * f * t + phase)


def gaussian(rng, x, fs):
    return x + rng.normal(size=len(x)) * rng.uniform(0.02, 0.2) * _sd(x)


def predicted(rng, x, fs):
    """Noise shaped like the residue of a linear prediction of order three."""
    c = x - x.mean()
    r = np.array([c[: len(c) - k] @ c[k:] for k in range(4)])
    a = np.linalg.solve(np.array([[r[abs(i - j)] for j in range(3)] for i in range(3)]) + 1e-9 * (r[0] + 1) * np.eye(3), r[1:])
    residue = c[3:] - sum(a[k] * c[2 - k : len(c) - 1 - k] for k in range(3))
    drawn = rng.choice(residue, len(x)) + rng.normal(size=len(x)) * residue.std() * 0.1
    return x + rng.uniform(0.1, 0.5) * drawn


def flattened(rng, x, fs):
    """The slow parts, where P and T waves are, at half their size."""
    *details, rest = fl.stationary_details(x[None, :], fl.SYM4, 4)
    return x - 0.5 * (rest[0] - rest[0].mean())


STEPS = {"rescale": (rescaled, 0.5), "arm": (arm_scaled, 0.3), "kernel": (convolved, 0.2), "morphology": (morphed, 0.3), "wander": (wandering, 0.5), "muscle": (muscular, 0.4), "steps": (stepped, 0.2), "clip": (clipped, 0.1), "gain": (gained, 0.2), "mains": (mains, 0.4), "gaussian": (gaussian, 0.5), "prediction": (predicted, 0.2), "flatten": (flattened, 0.1)}


def augment(signals: DataFrame, seed: int = 42, steps: dict | None = None) -> DataFrame:
    """rec_id, noisy, log (what was applied, joined by ;) for signals(rec_id, fs, x). A null or empty x gives an empty one."""
    chosen = steps or STEPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, logs = [], []
            for rec, fs, x in zip(*(batch.column(c).to_pylist() for c in (KEY, "fs", "x"))):
                y, log = np.array(x or [], float), []
                rng = np.random.default_rng([seed, zlib.crc32(str(rec).encode())])
                for name, (step, chance) in chosen.items():
                    if len(y) > 8 and rng.random() < chance:
                        y = step(rng, y, fs)
                        log.append(name)
                out.append(y)
                logs.append(";".join(log))
            yield pa.RecordBatch.from_arrays([batch.column(KEY), pa.array(out, pa.list_(pa.float64())), pa.array(logs)], [KEY, "noisy", "log"])

    return signals.select(KEY, "fs", "x").mapInArrow(run, f"{KEY} {dict(signals.dtypes)[KEY]}, noisy array<double>, log string")


def _draw(n: int, seed: int, *key: Column) -> Column:
    """A whole number in [-n, n] that depends on the key alone, unlike rand(), which depends on the partition."""
    return (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(2 * n + 1)) - n).cast("long")


def jittered_windows(samples: DataFrame, every: int, size: int, jitter: int, seed: int = 42) -> DataFrame:
    """rec_id, start, x: windows of `size` samples that begin at every `every`-th sample, moved by up to `jitter`; those not
    wholly inside are left out. A window's samples come by an equi-join on the blocks that it touches."""
    at = samples.where(F.col("idx") % every == 0).select(KEY, (F.col("idx") + _draw(jitter, seed, F.col(KEY), F.col("idx"))).alias("start"), F.col("idx").alias("k"))
    wide = at.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + size - 1) / size))))
    j = wide.join(samples.withColumn("block", F.floor(F.col("idx") / size)), [KEY, "block"]).where("idx >= start and idx < start + " + str(size))
    w = j.groupBy(KEY, "k", "start").agg(F.sort_array(F.collect_list(F.struct("idx", "v"))).alias("s")).where(F.size("s") == size)
    return w.select(KEY, "start", F.transform("s", lambda p: p["v"]).alias("x"))


def jittered(times: Column, most: int, seed: int, *key: Column) -> Column:
    """Times moved by a whole number in [-most, most]."""
    return times + _draw(most, seed, *key)
