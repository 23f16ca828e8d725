"""Windowed quality against direct sums, and the gate that it is."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemill.operators import windowed


def direct(x, fs, window_s=10.0, stride_s=5.0):
    """Per window: start, ratio, snr, kurtosis, skewness; None where a sample is missing."""
    size, stride = int(window_s * fs), int(stride_s * fs)
    n = min(size, int(2 * fs))
    out = []
    for start in range(0, len(x) - size + 1, stride):
        w = x[start : start + size]
        if np.isnan(w).any():
            out.append((start, None))
            continue
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
        spectra = []
        for s in range(0, size - n + 1, n - n // 2):
            y = (w[s : s + n] - w[s : s + n].mean()) * hann
            p = np.abs(np.fft.rfft(y)) ** 2 / (fs * (hann**2).sum())
            p[1 : len(p) - (n % 2 == 0)] *= 2
            spectra.append(p)
        p, f = np.mean(spectra, axis=0), np.arange(n // 2 + 1) * fs / n
        area = lambda m: np.trapezoid(p[m], f[m])  # noqa: E731, B023
        total, qrs = (f >= 0.5) & (f <= 40), (f >= 5) & (f <= 20)
        d = w - w.mean()
        m2, m3, m4 = ((d**k).mean() for k in (2, 3, 4))
        noise = area(total & ~qrs)
        out.append((start, (area(qrs) / area(total) if area(total) > 0 else 0.0, 10 * np.log10(area(qrs) / noise) if noise > 0 else 0.0, m4 / m2**2 - 3 if m2 > 0 else None, m3 / m2**1.5 if m2 > 0 else None)))
    return out


def rows(x, rec="r"):
    return [(rec, i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)]


@pytest.mark.parametrize("fs, window_s, stride_s", [(20.0, 10.0, 5.0), (25.0, 4.0, 1.0), (62.5, 6.0, 2.5), (21.0, 10.0, 3.0)])
def test_windows_equal_direct_sums(spark, fs, window_s, stride_s):
    rng = np.random.default_rng(int(fs))
    t = np.arange(int(33 * fs)) / fs
    x = np.sin(2 * np.pi * 8 * t) + rng.normal(0, 0.5, len(t)) + 1000
    x[int(20 * fs)] = np.nan
    want = direct(x, fs, window_s, stride_s)
    df = spark.createDataFrame(rows(x), "rec_id string, idx long, v double").repartition(5)
    got = {r.start_sample: r for r in windowed.window_sqi(df, fs, window_s, stride_s).collect()}
    assert sorted(got) == [s for s, _ in want]
    for s, w in want:
        r = got[s]
        assert (r.end_sample, r.window_idx) == (s + int(window_s * fs), s // int(stride_s * fs))
        if w is None:
            assert r.quality_label == "poor" and not r.is_usable and r.score is None
        else:
            assert np.allclose((r.qrs_energy_ratio, r.snr_db, r.kurtosis, r.skewness), w, atol=1e-8)


def test_a_long_recording_is_spread_over_panes(spark):
    df = spark.range(40_000).select(F.lit("one").alias("rec_id"), F.col("id").alias("idx"), F.sin(F.col("id") * 2.0).alias("v"))
    grid = windowed.Grid.of(20.0)
    held = windowed.panes(df, grid)
    assert held.agg(F.count("*"), F.max("n"), F.sum("n")).first() == (400, 100, 40_000)
    assert "Window" not in windowed.window_sqi(df, 20.0)._jdf.queryExecution().optimizedPlan().toString()


def test_edges(spark):
    flat, short, gap = [3.0] * 450, [1.0] * 199, [float(i % 7) for i in range(650)]
    data = rows(np.array(flat), "flat") + rows(np.array(short), "short") + [r for r in rows(np.array(gap), "gap") if not 210 <= r[1] < 420]
    data += [("wild", i, float("inf") if i == 3 else float("nan") if i == 4 else 1.0 * (i % 5)) for i in range(200)]
    got = windowed.window_sqi(spark.createDataFrame(data, "rec_id string, idx long, v double"), 20.0).collect()
    by = {(r.rec_id, r.window_idx): r for r in got}
    assert {k for k in by if k[0] == "short"} == set() and len([k for k in by if k[0] == "gap"]) == 5
    assert by["flat", 0].kurtosis is None and by["flat", 0].qrs_energy_ratio == 0 and by["flat", 0].score == 0.35
    assert by["gap", 0].score is not None and by["gap", 1].score is None and by["gap", 2].score is None and not by["gap", 2].is_usable
    assert by["wild", 0].score is None
    none = spark.createDataFrame([], "rec_id string, idx long, v double")
    assert windowed.window_sqi(none, 20.0).collect() == []


def test_the_gate_opens_for_good_signal_only(spark):
    rng = np.random.default_rng(0)
    t = np.arange(600) / 20
    x = np.where(t < 15, np.sin(2 * np.pi * 7 * t) + rng.normal(0, 0.1, 600), np.cumsum(rng.normal(0, 1, 600)) * 10)
    w = windowed.window_sqi(spark.createDataFrame(rows(x), "rec_id string, idx long, v double"), 20.0)
    beats = [("r", i, int(i * 800)) for i in range(36)] + [("r", 99, 9600), ("other", 1, 5)]
    got = {r.window_idx: r for r in windowed.gated_windows(w, spark.createDataFrame(beats, "rec_id string, peak_id long, t_ms long"), 20.0).collect()}
    assert got[0].is_usable and got[0].n_peaks == 14 and got[0].hr_bpm == 75.0  # two beats at one time: no interval
    assert not got[4].is_usable and (got[4].n_peaks, got[4].hr_bpm) == (0, 0.0)
    assert len(got) == 5
