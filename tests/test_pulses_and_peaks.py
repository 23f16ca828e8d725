"""Pulses of recordings with none, one and many; peaks with plateaus, ties and distances; densities at a recording's ends."""

import random

import numpy as np
import pytest

from pulsemill.operators import consensus, features as P, peaks, spectral

RNG = random.Random(5)


def samples_of(n):
    return [float(round(50 * np.sin(i / 4.0) + RNG.uniform(-3, 3) + 0.05 * i, 3)) for i in range(n)]


@pytest.fixture(scope="module")
def signals():
    return {"many": samples_of(300), "one": samples_of(40), "none": samples_of(30)}


@pytest.fixture(scope="module")
def rises():
    """(onset, peak) of each recording's pulses; the last of "many" is flat in its rise, one follows at a distance."""
    return {"many": [(19, 31), (45, 56), (70, 82), (94, 107), (121, 124), (145, 157), (200, 203)], "one": [(17, 30)], "none": []}


@pytest.fixture(scope="module")
def inside(spark, signals, rises):
    s = spark.createDataFrame([(r, i, v) for r, x in signals.items() for i, v in enumerate(x)], "rec_id string, idx long, v double").repartition(6)
    p = spark.createDataFrame([(r, o, k) for r, x in rises.items() for o, k in x], "rec_id string, onset long, peak long").repartition(4)
    return {w: P.pulse_samples(s, P.pulses(p), w).cache() for w in (13, 1 << 20)}


def bounds(rises):
    return [(r, o, p, x[i + 1][0] if i + 1 < len(x) else p) for r, x in rises.items() for i, (o, p) in enumerate(x)]


@pytest.mark.parametrize("width", [13, 1 << 20])
def test_samples_of_pulses(inside, signals, rises, width):
    got = sorted((r.rec_id, r.onset, r.peak, r.idx, r.v) for r in inside[width].collect())
    assert got == sorted((r, o, p, i, signals[r][i]) for r, o, p, e in bounds(rises) for i in range(o, e + 1))


def test_features_of_every_pulse(inside, signals, rises):
    want = {}
    for r, o, p, e in bounds(rises):
        x = np.array(signals[r])
        up = x[o : p + 1]
        g = np.gradient(up)
        k = int(g.argmax())
        foot = o + k + (up[0] - up[k]) / g[k] if g[k] > 0 else float(o)
        d = np.diff(up)
        j = int(d.argmax())
        at = int(o + j + (up[0] - up[j]) / d[j]) if d[j] > 0 else o
        refined = at if p - o <= 50 and len(up) >= 4 and d[j] > 0 and o <= at < p else o
        level, width = x[o] + 0.5 * (x[p] - x[o]), None
        rise = next((i for i in range(o, p + 1) if x[i] >= level), None)
        fall = next((i for i in range(p, e + 1) if x[i] <= level), None)
        if x[p] > x[o] and rise is not None and fall is not None:
            line = lambda i: i - 1 + (level - x[i - 1]) / (x[i] - x[i - 1])  # noqa: E731, B023
            width = (p if fall == p else line(fall)) - (o if rise == o else line(rise))
            width = width if width > 0 else None
        want[r, o] = (foot, refined, width, x[p] - x[o], p - o)
    df = inside[13]
    foot = {(r.rec_id, r.onset): r.foot for r in P.tangent_foot(df).collect()}
    refined = {(r.rec_id, r.onset): r.refined for r in P.refined_onsets(df, 50.0).collect()}
    wide = {(r.rec_id, r.onset): r.pw50 for r in P.half_width(df).collect()}
    rise = {(r.rec_id, r.onset): (r.rise_amp, r.rise_time) for r in P.rise(df).collect()}
    assert foot.keys() == refined.keys() == wide.keys() == rise.keys() == want.keys()
    for k, (f, d, w, a, t) in want.items():
        assert foot[k] == pytest.approx(f) and refined[k] == d and rise[k] == (pytest.approx(a), t)
        assert wide[k] == (None if w is None else pytest.approx(w)), k
    assert any(w is not None for _, _, w, _, _ in want.values()) and any(w is None for _, _, w, _, _ in want.values())


def plain_maxima(x):
    out, i = [], 1
    while i < len(x) - 1:
        if x[i - 1] < x[i]:
            j = i
            while j + 1 < len(x) and x[j + 1] == x[i]:
                j += 1
            if j + 1 < len(x) and x[j + 1] < x[i]:
                out.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    return out


def plain_spaced(places, heights, distance):
    left, out = sorted(zip(heights, places), reverse=True), []
    for h, p in left:
        if all(abs(p - q) >= distance for _, q in out):
            out.append((h, p))
    return sorted(p for _, p in out)


@pytest.mark.parametrize("width", [5, 1 << 20])
def test_peaks(spark, width):
    rng = random.Random(8)
    data = {r: [float(rng.randrange(4)) for _ in range(200)] for r in "ab"} | {"flat": [1.0] * 30, "edge": [5.0, 5.0, 1.0, 7.0, 7.0], "few": [2.0]}
    df = spark.createDataFrame([(r, i, v) for r, x in data.items() for i, v in enumerate(x)], "rec_id string, idx long, v double").repartition(5)
    got = peaks.local_maxima(df, width=width).collect()
    for r, x in data.items():
        assert sorted(g.idx for g in got if g.rec_id == r) == plain_maxima(x)
    near = peaks.find_peaks(df, 2.0, 7, width=width).collect()
    for r, x in data.items():
        own = [i for i in plain_maxima(x) if x[i] >= 2]
        assert sorted(g.idx for g in near if g.rec_id == r) == plain_spaced(own, [x[i] for i in own], 7)


def test_gaps_in_a_signal(spark):
    rows = [("r", i, v) for i, v in ((0, 1.0), (1, 3.0), (3, 1.0), (10, 2.0), (20, 5.0), (21, 4.0), (22, None), (23, 9.0), (24, float("nan")))]
    df = spark.createDataFrame(rows, "rec_id string, idx long, v double")
    n = spark.createDataFrame([("r", 25)], "rec_id string, n long")
    assert peaks.local_maxima(df).collect() == []
    assert sorted(r.idx for r in peaks.local_maxima(df, missing=0.0).collect()) == [1, 3, 10, 20, 23]
    assert sorted(r.idx for r in peaks.local_maxima(df.where("idx <= 20"), missing=0.0, lengths=n.selectExpr("rec_id", "21L AS n")).collect()) == [1, 3, 10]


def test_highest_first_takes_the_later_of_equals():
    stays = peaks.highest_first(np.array([0, 5, 10, 30]), np.array([1.0, 1.0, 1.0, 0.5]), 7)
    assert stays.tolist() == [True, False, True, True]


@pytest.mark.parametrize("n", [200, 30, 7])
def test_density_is_reflected_at_the_ends(spark, n):
    spikes = [(d, t) for d, t in (("x", 2), ("x", 2), ("y", 2), ("x", n - 1), ("y", n // 2), ("x", n + 3), ("x", -1))]
    df = spark.createDataFrame([("r", d, t) for d, t in spikes], "rec_id string, detector string, t long")
    lengths = spark.createDataFrame([("r", n)], "rec_id string, n long")
    kernel = np.exp(-0.5 * (np.arange(-20, 21) / 5.0) ** 2)
    want = np.zeros(n)
    for _, t in sorted({s for s in spikes if 0 <= s[1] < n}):
        for k, w in zip(range(-20, 21), kernel / kernel.sum()):
            x = (t + k) % (2 * n)
            want[x if x < n else 2 * n - 1 - x] += w
    got = {r.t: r.density for r in consensus.density(df, None, 5.0, lengths=lengths).collect()}
    assert set(got) <= set(range(n)) and np.allclose([got.get(t, 0) for t in range(n)], want / want.max())
    top = consensus.consensus_peaks(consensus.density(df, None, 5.0, lengths=lengths), lengths).collect()
    places = [i for i in plain_maxima(np.round(want / want.max(), 9).tolist()) if want[i] / want.max() >= 0.4]
    assert sorted(r.t for r in top) == plain_spaced(places, [want[i] for i in places], 15)


def test_without_lengths_a_density_goes_on(spark):
    df = spark.createDataFrame([("r", 2, 1.0)], "rec_id string, t long, w double")
    assert spectral.gaussian_density(df, 5.0).count() == 41


def test_prominences(spark):
    rng = random.Random(9)
    data = {"a": [float(rng.randrange(9)) for _ in range(300)], "b": [0.0, 3.0, 1.0, 3.0, 0.5, 2.0, 0.0], "c": [1.0, 2.0, 1.5]}
    df = spark.createDataFrame([(r, i, v) for r, x in data.items() for i, v in enumerate(x)], "rec_id string, idx long, v double").repartition(5)
    got = {(r.rec_id, r.idx): r.prominence for r in peaks.prominences(df, peaks.local_maxima(df)).collect()}
    want = {}
    for r, x in data.items():
        for p in plain_maxima(x):
            left, right = p, p
            while left > 0 and x[left - 1] <= x[p]:
                left -= 1
            while right < len(x) - 1 and x[right + 1] <= x[p]:
                right += 1
            want[r, p] = x[p] - max(min(x[left : p + 1]), min(x[p : right + 1]))
    assert got == want and want["b", 1] == 3.0 and want["b", 5] == 1.5
