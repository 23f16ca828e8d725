import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsemill.functions import filters as fl, scalars as S, thresholds as th
from pulsemill.operators import augment, consensus, detectors as D, features as P, fills, joins as J, quality as Q, secondary, spectral, windows as W


def peaks(spark, rows):
    return spark.createDataFrame(rows, "rec_id long, peak_id long, t_ms long")


def greedy(refs, tests, tol):
    taken = set()
    for t in tests:
        if refs:
            i = min(range(len(refs)), key=lambda k: (abs(refs[k] - t), k))
            if abs(refs[i] - t) <= tol:
                taken.add(i)
    return len(taken)


def test_beat_counts_equal_a_greedy_loop(spark):
    rng = random.Random(1)
    refs, tests, want = [], [], {}
    for rec in range(60):
        r = sorted(rng.randrange(3000) for _ in range(rng.randrange(12)))
        t = sorted(rng.randrange(3000) for _ in range(rng.randrange(12)))
        refs += [(rec, rec * 100 + i, x) for i, x in enumerate(r)]
        tests += [(rec, rec * 100 + i, x) for i, x in enumerate(t)]
        if r or t:
            want[rec] = (len(r), len(t), greedy(r, t, 50))
    got = {x.rec_id: x for x in J.beat_counts(peaks(spark, tests), peaks(spark, refs), 50).collect()}
    assert {k: (x.n_ref, x.n_test, x.tp) for k, x in got.items()} == want
    assert all(x.tp + x.fn == x.n_ref and x.tp + x.fp == x.n_test for x in got.values())


def test_joins_of_nothing_and_of_ties(spark):
    none, one = peaks(spark, []), peaks(spark, [(1, 1, 100), (1, 2, 100), (2, 3, None)])
    assert J.beat_counts(none, none, 50).count() == 0
    assert J.nearest(none, one, {"peak_id": "r"}).count() == 0
    got = {r.peak_id: r.r for r in J.nearest(one, peaks(spark, [(1, 7, 100), (1, 8, 100), (1, 9, 90)]), {"peak_id": "r"}).collect()}
    assert got[1] == got[2] == 7 and got[3] is None
    back = J.last_before(one, peaks(spark, [(1, 5, 100), (1, 6, 50)]), {"peak_id": "m"}, strict=True).collect()
    assert {r.m for r in back if r.rec_id == 1} == {6}


def test_band_join_equals_all_pairs(spark):
    rng = random.Random(3)
    left = [(rng.randrange(4), i, rng.randrange(-500, 500)) for i in range(80)]
    right = [(rng.randrange(4), i, rng.randrange(-500, 500)) for i in range(80)]
    l = spark.createDataFrame(left, "rec_id long, a long, t long").withColumn("lo", F.col("t") - 40).withColumn("hi", F.col("t") + 25)
    r = spark.createDataFrame(right, "rec_id long, b long, u long")
    want = {(x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[2] - 40 <= y[2] <= x[2] + 25}
    got = J.band_join(l, r, "lo", "hi", "u", 65)
    assert sorted((x.a, x.b) for x in got.collect()) == sorted(want)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    semi = J.band_join(l, r, "lo", "hi", "u", 65, "left_semi")
    assert sorted(x.a for x in semi.collect()) == sorted({a for a, _ in want})
    assert J.band_join(l, r, "lo", "hi", "u", 65, "left_anti").count() == 80 - len({a for a, _ in want})


@pytest.mark.parametrize("n,width", [(1, 5), (2, 5), (3, 9), (20, 5), (7, 15)])
def test_median_filter_mirrors_edges(spark, n, width):
    x = np.random.default_rng(n).normal(size=n)
    k = width // 2
    mirror = [(i % (2 * n)) if (i % (2 * n)) < n else 2 * n - 1 - (i % (2 * n)) for i in range(-k, n + k)]
    want = [float(np.median(x[mirror[i : i + width]])) for i in range(n)]
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "rec_id long, idx long, v double")
    got = [r.v for r in W.median_filter(df, width).orderBy("idx").collect()]
    assert got == pytest.approx(want)


def test_fills(spark):
    nan = None
    x = [nan, 1.0, nan, nan, 4.0] + [nan] * 12 + [17.0, nan]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)] + [(2, 0, nan), (2, 1, nan)], "rec_id long, idx long, v double")
    got = [r.v for r in fills.interpolate(df, empty=0.0).orderBy("rec_id", "idx").collect()]
    assert got == pytest.approx([1.0, 1.0, 2.0, 3.0] + list(map(float, range(4, 18))) + [17.0, 0.0, 0.0])
    again = fills.interpolate(fills.interpolate(df, empty=0.0), empty=0.0).orderBy("rec_id", "idx").collect()
    assert [r.v for r in again] == got
    lim = [r.v for r in fills.interpolate_limited(df, 10).where("rec_id = 1").orderBy("idx").collect()]
    assert lim[5:15] == pytest.approx(list(range(5, 15))) and lim[15:17] == [17.0, 17.0] and lim[-1] == 17.0 and lim[0] == 1.0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 300), st.integers(1, 60), st.integers(1, 30), st.booleans())
def test_window_numbers(n, size, stride, closed):
    starts = list(range(0, n - size + (1 if closed else 0), stride))
    fits = n - size if closed else n - size - 1
    assert len(starts) == (0 if fits < 0 else fits // stride + 1)


def test_windows_of_hold_each_place(spark):
    df = spark.range(60).select(W.windows_of(F.col("id"), 20, 7, W.full_windows(F.lit(60), 20, 7)).alias("w"), "id")
    for r in df.collect():
        assert r.w == [k for k in range(6) if k * 7 <= r.id < k * 7 + 20]


def test_words_and_scalars(spark):
    words = [(3 << 3), (1 << 3) | (5 << 6), 0xFFFFFF & ~(7 << 3) | (2 << 3), (7 << 3)]
    got = [r.v for r in spark.createDataFrame([(w,) for w in words], "w long").select(S.decode_word(F.col("w")).alias("v")).collect()]
    mv = 1000 / (2**17 * 20)
    assert got[0] is None and got[3] is None and got[1] == pytest.approx(5 * mv) and got[2] == pytest.approx(-1 * mv)
    times = spark.createDataFrame([("2025-07-02 10:00:00.000",), ("07/02/2025 10:00:00",), ("02.07.2025 10:00:00",), ("later",)], "t string").select(S.fixed_time(F.col("t")).alias("t")).collect()
    assert len({r.t for r in times[:3]}) == 1 and times[3].t is None
    v = spark.createDataFrame([(float("nan"),), (float("inf"),), (-99.0,), (1.0,)], "v double").select(S.valid(F.col("v")).alias("v")).collect()
    assert [r.v for r in v] == [None, None, None, 1.0]


def test_butterworth_design():
    for order, lo, hi in ((4, 5, 15), (3, None, 20), (2, 10, None), (5, 0.5, 40)):
        sos = fl.butter(order, lo, hi, 100)
        response = lambda f: abs(np.prod([np.polyval(s[:3], z) / np.polyval(s[3:], z) for s in sos])) if (z := np.exp(2j * np.pi * f / 100)) else 0  # noqa: B023
        for edge in (e for e in (lo, hi) if e):
            assert response(edge) == pytest.approx(2**-0.5, rel=1e-6)
        middle = math.sqrt(lo * hi) if lo and hi else (0.01 if hi else 49.0)
        assert response(middle) == pytest.approx(1, abs=0.02)
        assert all(abs(p) < 1 for s in sos for p in np.roots(s[3:]))


def test_zero_phase_and_notch():
    t = np.arange(1000) / 250
    x = np.sin(2 * np.pi * 10 * t) + 3
    y = fl.bandpass(x[None, :], 250, 0.5, 40)[0]
    assert np.abs(y[200:-200] - np.sin(2 * np.pi * 10 * t)[200:-200]).max() < 0.05
    assert np.abs(fl.zero_phase(fl.notch(60, 30, 250), np.sin(2 * np.pi * 60 * t)[None, :])[0][300:-300]).max() < 0.05
    pulse = np.zeros((1, 401))
    pulse[0, 200] = 1
    z = fl.bandpass(pulse, 250, 5, 15)[0]
    assert np.allclose(z, z[::-1], atol=1e-3 * np.abs(z).max())
    step = fl.run(fl.butter(2, None, 20, 250), np.ones((1, 50)), fl.steady(fl.butter(2, None, 20, 250)))
    assert np.allclose(step, 1)


def test_transforms():
    t = np.arange(512) / 128
    x = np.cos(2 * np.pi * 8 * t)[None, :]
    assert np.abs(fl.envelope(x) - 1).max() < 1e-6
    assert np.abs(fl.resample_fft(x, 1024)[0][::2] - x[0]).max() < 1e-9
    up = fl.resample_ratio(x, 2, 1)[0]
    assert len(up) == 1024 and np.abs(up[::2] - x[0])[40:-40].max() < 0.02
    assert np.allclose(fl.denoise(x, share=0.0), x, atol=1e-8)
    assert np.abs(fl.morlet_band(np.cos(2 * np.pi * 40 * t)[None, :], 128, 1, 10)).max() < 0.05


def test_find_peaks():
    x = np.array([0, 2, 2, 2, 0, 1, 0, 5, 0, 4.9, 0])
    assert fl.find_peaks(x).tolist() == [2, 5, 7, 9]
    assert fl.find_peaks(x, height=2).tolist() == [2, 7, 9]
    assert fl.find_peaks(x, distance=3).tolist() == [2, 7]
    assert fl.find_peaks(x, prominence=1.5).tolist() == [2, 7, 9]
    assert fl.find_peaks(np.array([1.0])).tolist() == [] == fl.find_peaks(np.ones(5)).tolist()


def beats(fs=250.0, bpm=75, seconds=20, seed=0):
    rng = np.random.default_rng(seed)
    n, step = int(seconds * fs), int(60 / bpm * fs)
    at = np.arange(step, n - step, step)
    t = np.arange(-int(0.05 * fs), int(0.05 * fs) + 1) / fs
    x = rng.normal(size=n) * 0.01
    for p in at:
        x[p + np.arange(-int(0.05 * fs), int(0.05 * fs) + 1)] += np.exp(-((t / 0.012) ** 2))
    return x, at


@pytest.mark.parametrize("method", [m for m, k in D.REGISTRY.items() if k and m != "pulse"])
def test_detectors_find_beats(method):
    x, at = beats()
    found = np.array(D.REGISTRY[method](x[None, :], 250.0)[0])
    # a causal filter's delay is allowed for
    hits = sum(np.any(np.abs(found - p) <= 60) for p in at)
    assert hits >= 0.85 * len(at) and len(found) <= 1.25 * len(at)


def test_pulse_detector():
    fs, t = 100.0, np.arange(3000) / 100.0
    x = np.sin(2 * np.pi * 1.25 * t) + 0.05 * t
    found = np.array(D.pulse_beats(x[None, :], fs)[0])
    want = (np.arange(37) + 0.25) / 1.25 * fs
    assert np.mean([np.any(np.abs(found - p) <= 4) for p in want]) > 0.9


def test_detect_reports_failures(spark):
    x, at = beats(seconds=5)
    df = spark.createDataFrame([(1, 250.0, x.tolist()), (2, 250.0, []), (3, 250.0, None)], "rec_id long, fs double, x array<double>")
    got = {(r.rec_id, r.detector): r for r in D.detect_all(df, {m: D.REGISTRY[m] for m in ("pan_tompkins_full", "two_average")}).collect()}
    assert len(got) == 6 and got[1, "pan_tompkins_full"].error is None and len(got[1, "pan_tompkins_full"].peaks) >= len(at) - 1
    assert got[2, "two_average"].peaks == [] and "no samples" in got[3, "two_average"].error
    with pytest.raises(ValueError, match="model"):
        D.detect(df, "deep_model")


def test_frames_have_halos(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(25)], "rec_id long, idx long, v double")
    got = {r.frame_idx: (r.start_idx, r.x) for r in D.frame(df, 10, 10, 3).collect()}
    assert got == {0: (0, [float(i) for i in range(13)]), 1: (7, [float(i) for i in range(7, 23)]), 2: (17, [float(i) for i in range(17, 25)])}


def test_augmentation_is_seeded(spark):
    x, _ = beats(seconds=3)
    df = spark.createDataFrame([(i, 250.0, x.tolist()) for i in range(12)] + [(99, 250.0, None)], "rec_id long, fs double, x array<double>")
    a = {r.rec_id: (r.log, r.noisy) for r in augment.augment(df).collect()}
    b = {r.rec_id: (r.log, r.noisy) for r in augment.augment(df.repartition(5)).collect()}
    assert a == b and a[99] == ("", []) and len({v[0] for v in a.values()}) > 3
    assert all(len(v) == len(x) for k, (_, v) in a.items() if k != 99)
    every = augment.augment(df.where("rec_id = 1"), steps={k: (f, 1.1) for k, (f, _) in augment.STEPS.items()}).first()
    assert every.log.split(";") == list(augment.STEPS) and np.isfinite(every.noisy).all()


def test_lag_is_found_whatever_the_sign(spark):
    rng = np.random.default_rng(2)
    x = np.convolve(rng.normal(size=80), np.ones(4), "same")
    a, b = x[10:74], -x[5:69]
    df = spark.createDataFrame([(1, a.tolist(), b.tolist())], "rec_id long, a array<double>, b array<double>")
    r = {x.lag: x.r for x in spectral.xcorr(df, 64, 10).collect()}
    assert max(r, key=r.get) == 5


def test_thinning_and_acceptance(spark):
    ts = [0, 100, 201, 400, 401, 700]
    df = spark.createDataFrame([(1, t) for t in ts], "rec_id long, t_ms long")
    kept, last = [], None
    for t in ts:
        if last is None or t - last > 200:
            kept.append(t)
            last = t
    assert sorted(r.t_ms for r in consensus.thin(df, 200).collect()) == kept
    xs = [(1, i, float(p)) for i, p in enumerate([200, 205, 210, 300, 208, 212])]
    d = spark.createDataFrame(xs, "rec_id long, peak_id long, pat double")
    assert sorted(x.peak_id for x in P.accepted_delays(d, ["peak_id"]).collect()) == [0, 1, 2, 4, 5]


def test_composite_quality_thresholds(spark):
    rows = [(0.3, 1.0, 3.0, 0.9), (0.2, -3.0, 10.0, 0.5), (0.12, -7.0, 1.0, 0.3), (0.05, -20.0, 20.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = df.select(F.round(Q.composite(*map(F.col, "abcd")), 3).alias("s"), Q.label(Q.composite(*map(F.col, "abcd"))).alias("l")).collect()
    assert [(r.s, r.l) for r in got] == [(1.0, "good"), (0.6, "mediocre"), (0.2, "poor"), (0.0, "poor")]


def test_scalogram_of_short_signals():
    assert th.scalogram_maxima(np.ones(2), 20).tolist() == [] and th.blocks(np.zeros(5), np.ones(5), np.zeros(5), 10) == []
    assert th.levels(np.zeros(100), 50) == [] and th.steep_slope(np.zeros(0), 50) == [] == th.rise_and_fall(np.zeros(0), np.zeros(0), 50)


def test_preprocessing_says_what_it_did(spark):
    t = np.arange(2000) / 250.0
    beat = lambda sign: sign * np.exp(-(((t % 0.8) - 0.4) / 0.02) ** 2) + 0.3 * np.sin(2 * np.pi * 60 * t) + t
    up, down = beat(1.0), beat(-1.0)
    holes = up.copy().tolist()
    holes[100:110] = [None] * 5 + [float("nan")] * 5
    rows = [(1, 250.0, up.tolist()), (2, 250.0, down.tolist()), (3, 250.0, holes), (4, 250.0, []), (5, 250.0, None)]
    got = {r.rec_id: r for r in D.preprocessed(spark.createDataFrame(rows, "rec_id long, fs double, x array<double>")).collect()}
    plain = ["notch_60Hz", "bandpass_0.5-40Hz", "baseline_removal"]
    assert got[1].steps == plain and not got[1].inverted
    assert got[2].steps == [*plain, "auto_inverted"] and got[2].inverted
    assert got[3].steps == ["interpolate_invalid", *plain] and np.allclose(got[3].x[300:], got[1].x[300:], atol=0.05)
    # mains and trend are turned over, too, where they are left
    assert np.corrcoef(got[1].x[300:-300], got[2].x[300:-300])[0, 1] > 0.95 and got[4].x == [] == got[4].steps and got[5].x is None
    off = D.Preprocess(notch=None, band=None, baseline=False, auto_invert=False)
    assert {r.rec_id: r.x for r in D.preprocessed(spark.createDataFrame(rows[:1], "rec_id long, fs double, x array<double>"), off).collect()}[1] == up.tolist()


def test_filter_chains():
    t = np.arange(2500) / 250.0
    slow, wave, mains = 2 * np.sin(2 * np.pi * 0.05 * t), np.sin(2 * np.pi * 8 * t), np.sin(2 * np.pi * 50 * t)
    inner = slice(500, -500)
    got = D.ecg_filter()((slow + wave + mains)[None, :], 250.0)[0]
    assert np.abs(got - wave)[inner].max() < 0.1
    spikes = np.zeros(2500)
    spikes[::400] = 50
    pulse = np.sin(2 * np.pi * 1.5 * t)
    for how in ({}, D.ROBUST_PPG):
        got = D.ppg_filter(**how)((pulse + 0.5 * t + spikes)[None, :], 250.0)[0]
        assert abs(got.mean()) < 0.01 and abs(got.std() - 1) < 0.01 and np.corrcoef(got[inner], pulse[inner])[0, 1] > 0.98
    assert D.resampled(D.ppg_filter(), 100.0)(pulse[None, :], 250.0).shape == (1, 1000)
    for k in D.PIPELINES.values():
        assert k((wave + mains)[None, :], 250.0).shape == (1, 2500)


def test_front_end_drops_unusual_heights():
    x, at = beats(seconds=30)
    x[at[5]] *= 6
    plain, kept = (np.array(k(x[None, :], 250.0)[0]) for k in (D.pan_tompkins_full, D.front_end(D.pan_tompkins_full)))
    assert len(kept) == len(plain) - 1 and np.abs(kept - at[5]).min() > 50


def test_secondary_peaks_show_where_t_waves_are(spark):
    x = np.zeros(4000)
    marks = list(range(200, 3900, 200))
    x[marks] = 10.0
    x[np.array(marks[8:13]) + 75] = 3.0
    signal = spark.createDataFrame([(r, i, float(v)) for r in ("waves", "few") for i, v in enumerate(x)] + [("none", 0, 1.0)], "rec_id string, idx long, v double")
    beats = spark.createDataFrame([("waves", m) for m in marks] + [("few", m) for m in marks[:3]], "rec_id string, idx long")
    got = {r.rec_id: tuple(r)[1:] for r in secondary.prominent_stretch(signal, beats, 250.0).collect()}
    # of the stretches with all of four waves before their last interval the earliest
    assert got == {"waves": (marks[8], marks[13], 4, marks[8] + 75), "few": (0, 1250, 0, None), "none": (0, 1, 0, None)}
    found = [r for r in secondary.intervals(signal, beats, 250.0, 37).collect() if r.rec_id == "waves"]
    assert len(found) == len(marks) and all(r.top == 10.0 for r in found)
    assert sorted((r.beat, *p) for r in found for p in r.peaks) == [(m, m + 75, 3.0) for m in marks[8:13]]


def test_alignment_moves_and_clips(spark):
    from pulsemill.operators import sync

    ref = spark.createDataFrame([(1, float(i), float(i)) for i in range(20)], "rec_id long, x double, v double")
    other = spark.createDataFrame([(1, i * 2.0, i * 20.0) for i in range(10)], "rec_id long, x double, v double")
    shift = lambda s: spark.createDataFrame([(1, s)], "rec_id long, shift double")
    got = {r.x: r.other for r in sync.aligned(ref, other, shift(4.0)).collect()}
    assert got == {float(i): (i + 4) * 10.0 for i in range(15)}
    with pytest.raises(Exception, match="no overlap"):
        sync.aligned(ref, other, shift(100.0)).collect()


def test_onsets_lie_between_peaks(spark):
    v = [5, 1, 2, 9, 3, 0, 4, 8, 7]
    s = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "rec_id long, idx long, v double")
    crests = spark.createDataFrame([(1, 3), (1, 7), (2, 4)], "rec_id long, peak long")
    assert {(r.peak, r.onset) for r in P.onsets(s, crests, 3).collect()} == {(3, 1), (7, 5)}


def test_thinning_by_runs_is_the_fold(spark):
    rng = np.random.default_rng(5)
    rows = [(r, int(t)) for r in range(4) for t in np.cumsum(rng.integers(1, 260, 200))]
    want = set()
    for r in range(4):
        last = None
        for t in sorted({t for q, t in rows if q == r}):
            if last is None or t - last > 200:
                want.add((r, t))
                last = t
    assert {tuple(x) for x in consensus.thin(spark.createDataFrame(rows, "rec_id long, t_ms long"), 200).collect()} == want


def test_table_function(spark):
    x, at = beats(seconds=10)
    D.register_functions(spark)
    spark.createDataFrame([(1, 250.0, x.tolist()), (2, 250.0, None)], "rec_id long, fs double, x array<double>").createOrReplaceTempView("signals_")
    got = [r.peak_idx for r in spark.sql("SELECT rec_id, peak_idx FROM signals_, LATERAL detect_beats(fs, x, 'pan_tompkins_full') ORDER BY peak_idx").collect()]
    assert got == D.pan_tompkins_full(x[None, :], 250.0)[0]


def test_shards_and_manifest(spark, tmp_path):
    from pulsemill.sources import sinks

    df = spark.range(25).selectExpr("id as rec_id", "array(1.0D, 2.0D) as x").coalesce(1)
    sinks.write_shards(df, str(tmp_path / "s"), 10)
    assert sorted(r.n_rows for r in sinks.manifest(spark, str(tmp_path / "s")).collect()) == [5, 10, 10]
