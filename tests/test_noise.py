"""Noise models fitted over all records, noise at a ratio, and test windows with their truth."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemill.operators import noise as N

A = np.array([0.6, -0.3, 0.1])


def series(n, seed):
    rng = np.random.default_rng(seed)
    x = np.zeros(n + 3)
    for i in range(n):
        x[i + 3] = A @ x[i : i + 3][::-1] + rng.normal()
    return x[3:]


@pytest.fixture(scope="module")
def records(spark):
    rows = [(f"r{s}", "ar" if s < 3 else "white", i, float(v)) for s in range(4) for i, v in enumerate(series(1500, s) if s < 3 else np.random.default_rng(9).normal(size=1500))]
    rows += [("r0", "ar", 1500 + i, None) for i in range(3)] + [("still", "still", i, 0.0) for i in range(5)]
    return spark.createDataFrame(rows, "rec_id string, kind string, idx long, v double").repartition(6)


def test_levinson_solves_the_equations():
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    r = np.array([x[: 400 - k] @ x[k:] for k in range(5)])
    want = np.linalg.solve([[r[abs(i - j)] for j in range(4)] for i in range(4)], r[1:])
    assert N.levinson(r) == pytest.approx(want) and N.levinson(np.zeros(4)).tolist() == [0, 0, 0]


def test_one_model_for_all_records_of_a_kind(records):
    got = {r.kind: r for r in N.fit(records).collect()}
    assert got["ar"].n == 4500 and np.allclose(got["ar"].a, A, atol=0.05) and np.allclose(got["white"].a, 0, atol=0.08)
    table = got["ar"].residues
    assert len(table) == N.TABLE and table == sorted(table) and abs(np.std(table) - 1) < 0.1 and 0 < got["ar"].width < 0.5
    assert list(got["still"].a) == [0, 0, 0]


def test_noise_at_a_ratio(spark, records):
    t = np.arange(2000) / 100
    rows = [(i, k, (np.sin(t) * (i + 1)).tolist()) for i, k in enumerate(["ar", "white", "ar"])] + [(7, "ar", []), (8, "ar", [0.0] * 10)]
    x = spark.createDataFrame(rows, "rec_id long, kind string, x array<double>")
    models = N.fit(records)
    got = {r.rec_id: np.array(r.noisy) for r in N.with_noise(x, models, 6.0).collect()}
    for i, _, clean in rows[:3]:
        clean = np.array(clean)
        noise = got[i] - clean
        assert 10 * np.log10((clean**2).mean() / (noise**2).mean()) == pytest.approx(6, abs=0.1)
        r = np.array([noise[: 2000 - k] @ noise[k:] for k in range(4)])
        assert np.allclose(N.levinson(r), A if i != 1 else 0, atol=0.12)
    assert len(got[7]) == 0 and len(got[8]) == 10
    again = {r.rec_id: np.array(r.noisy) for r in N.with_noise(x.repartition(3), models, F.lit(6.0)).collect()}
    assert all(np.allclose(again[i], got[i], rtol=1e-6, atol=1e-9) for i in (0, 1, 2))


def test_windows_of_a_weak_lead(spark):
    t = np.arange(500) / 100
    rows = [(i, np.sin(2 * np.pi * t).tolist(), [25, 125, 225]) for i in range(5)] + [(9, [1.0] * 20, []), (10, [], None)]
    got = {r.rec_id: r for r in N.weak_lead_windows(spark.createDataFrame(rows, "rec_id long, x array<double>, peaks array<int>"), 100.0).collect()}
    for i in range(5):
        r = got[i]
        assert np.ptp(r.clean) == pytest.approx(r.peak_to_peak) and N.PEAK_TO_PEAK[0] <= r.peak_to_peak <= N.PEAK_TO_PEAK[1] and 10 <= r.snr_db <= 24
        assert r.truth[25] == 0 and r.truth[30] == 5 and r.truth[75] == 50 and max(r.truth) == 50 and len(r.noisy) == 500
    assert got[9].truth == [50.0] * 20 and got[10].noisy == []
