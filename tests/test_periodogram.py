"""Periodograms against direct sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemill.operators import periodogram as L

FREQS = L.Frequencies(0.001, 0.4 / 100, 101)


def direct(t, y, f, floating):
    """One frequency: sine and cosine (and a constant) fitted by least squares; half of the drop of the squared error."""
    w = 2 * np.pi * f
    d = y - y.mean()
    columns = [np.cos(w * t), np.sin(w * t)] + ([np.ones(len(t))] if floating else [])
    fit = np.linalg.lstsq(np.column_stack(columns), d, rcond=None)[0]
    return ((d**2).sum() - ((d - np.column_stack(columns) @ fit) ** 2).sum()) / 2


@pytest.mark.parametrize("floating", [False, True])
def test_power(floating):
    rng = np.random.default_rng(1)
    t = np.sort(rng.uniform(0, 290, 300))
    y = 800 + 30 * np.sin(2 * np.pi * 0.1 * t) + rng.normal(0, 10, 300)
    got = L.power(L.sums(t, y, FREQS), floating)
    want = [direct(t, y, f, floating) for f in FREQS.f]
    assert got == pytest.approx(want, rel=1e-6)
    assert abs(FREQS.f[got.argmax()] - 0.1) < 0.005
    later = L.power(L.sums(t[:100], y[:100], FREQS) + L.sums(t[100:], y[100:], FREQS), floating)
    assert later == pytest.approx(got, rel=1e-9)


def test_exponentials():
    t = np.array([0.0, 1.5, 299.9])
    want = np.exp(2j * np.pi * np.outer(t, FREQS.f))
    assert np.abs(L.exponentials(t, FREQS) - want).max() < 1e-11 and L.exponentials(np.zeros(0), FREQS).shape == (0, 101)


@pytest.mark.parametrize("block", [1, 3, 64])
def test_windows(spark, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    rng = np.random.default_rng(2)
    t = np.cumsum(rng.integers(300, 1500, 900))
    t = t[(t < 200_000) | (t > 420_000)] - t[0]
    y = 800 + 40 * np.sin(2 * np.pi * 0.25 * t / 1000) + rng.normal(0, 5, len(t))
    size, stride, least = 120_000, 30_000, 50
    count = int((t[-1] - size) // stride + 1)
    df = spark.createDataFrame([("r", int(a), float(b), count) for a, b in zip(t, y)] + [("short", 0, 1.0, 0)], "rec_id string, t_ms long, y double, count long").repartition(5)
    bands = {"lf": (0.04, 0.15), "hf": (0.15, 0.4)}
    found = L.window_bands(df, FREQS, size, stride, least, bands)
    got = {r.win: (r.lf, r.hf) for r in found.collect()}
    want = {}
    for w in range(count):
        at = (t >= w * stride) & (t < w * stride + size)
        if at.sum() > least:
            p = np.array([direct(t[at] / 1000, y[at], f, False) for f in FREQS.f])
            inside = [(FREQS.f >= lo) & (FREQS.f < hi) for lo, hi in bands.values()]
            want[w] = tuple(np.trapezoid(p[i], FREQS.f[i]) for i in inside)
    assert got.keys() == want.keys() and 0 < len(want) < count
    for w in want:
        assert got[w] == pytest.approx(want[w], rel=1e-6)
    made = found._jdf.queryExecution().optimizedPlan().toString()
    assert made.count("Generate") == 1  # points go to blocks; none is repeated for a frequency


def test_whole_recordings(spark):
    rng = np.random.default_rng(3)
    rows = [(rec, int(x), float(rng.normal())) for rec in ("a", "b") for x in np.cumsum(rng.integers(300, 1500, 400))]
    df = spark.createDataFrame(rows, "rec_id string, t_ms long, y double").repartition(4)
    whole = {r.rec_id: r.power for r in L.whole_power(df, FREQS, 10_000_000, True).collect()}
    cut = {r.rec_id: r.power for r in L.whole_power(df, FREQS, 20_000, True).collect()}
    for rec in ("a", "b"):
        t, y = (np.array([r[k] for r in rows if r[0] == rec], float) for k in (1, 2))
        assert cut[rec] == pytest.approx(whole[rec], rel=1e-7)
        assert whole[rec][::20] == pytest.approx([direct(t / 1000, y, f, True) for f in FREQS.f[::20]], rel=1e-6)
    assert L.whole_power(df.where(F.lit(False)), FREQS, 1000).collect() == []
