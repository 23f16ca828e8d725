"""SIG, PRE, DET, FILL-05/06, PK, SQI-09, WIN-25 and AUG: what needs a recurrence, a transform or randomness.

Filters run on frames of 64 samples. Those that are cascades of second-order sections, or sums of taps, have a SQL twin, in which
the recurrence is a recursive query.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import filters as fl
from ..operators import augment as A, detectors as D, noise as NZ, peaks as K, secondary as T
from .bindings import FR, ORDER, SM, frames, samples
from .registry import query

RATE, N = 50.0, 64


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    return frames(spark, sf).select("rec_id", F.lit(RATE).alias("fs"), "x")


def _values(signals: DataFrame) -> DataFrame:
    return signals.select("rec_id", F.posexplode("x").alias("idx", "v")).select("rec_id", F.col("idx").cast("long").alias("idx"), (F.round("v", 6) + 0.0).alias("v"))  # no negative zeros


def _cascade(src: str, out: str, sos: np.ndarray, steady: np.ndarray | None = None) -> str:
    """CTEs that run second-order sections over src(rec_id, x), to out(rec_id, x)."""
    k = len(sos)
    starts = ", ".join(f"{0.0 if steady is None else float(steady[i][j])!r}::DOUBLE * x[1] AS z{i}{j}" for i in range(k) for j in (0, 1))
    rows = f"SELECT r.*, s.x[r.i + 1] AS v0 FROM {out}_r r JOIN {src} s USING (rec_id) WHERE r.i < len(s.x)"
    for i, section in enumerate(sos):
        b0, b1, b2, _, a1, a2 = (f"{float(c)!r}::DOUBLE" for c in section)
        rows = f"SELECT *, {b0} * v{i} + z{i}0 AS v{i + 1} FROM ({rows})"
        rows = f"SELECT *, {b1} * v{i} - {a1} * v{i + 1} + z{i}1 AS n{i}0, {b2} * v{i} - {a2} * v{i + 1} AS n{i}1 FROM ({rows})"
    states = ", ".join(f"n{i}{j}" for i in range(k) for j in (0, 1))
    return f"""{out}_r AS (SELECT rec_id, 0 AS i, NULL::DOUBLE AS y, {starts} FROM {src} UNION ALL SELECT rec_id, i + 1, v{k}, {states} FROM ({rows})),
{out} AS (SELECT rec_id, list(y ORDER BY i) AS x FROM {out}_r WHERE i > 0 GROUP BY rec_id)"""


def _there_and_back(src: str, out: str, sos: np.ndarray, n: int = N) -> str:
    """CTEs of the zero-phase run with odd extension at the ends."""
    taps = 2 * len(sos) + 1 - min((sos[:, 2] == 0).sum(), (sos[:, 5] == 0).sum())
    pad, z = int(min(3 * taps, n - 1)), fl.steady(sos)
    wide = f"""{out}_w AS (SELECT rec_id, list_transform(range({pad}), lambda i: 2 * x[1] - x[{pad + 1} - i]) || x || list_transform(range({pad}), lambda i: 2 * x[{n}] - x[{n - 1} - i]) AS x FROM {src})"""
    back = f"{out}_v AS (SELECT rec_id, list_reverse(x) AS x FROM {out}_f)"
    return ", ".join([wide, _cascade(f"{out}_w", f"{out}_f", sos, z), back, _cascade(f"{out}_v", f"{out}_b", sos, z), f"{out} AS (SELECT rec_id, list_reverse(x)[{pad + 1} : {pad + n}] AS x FROM {out}_b)"])


def _chain(*sections: np.ndarray) -> str:
    """SQL of zero-phase filters, one after another, over the frames."""
    names = ["fr", *[f"s{i}" for i in range(len(sections))]]
    return _listed([_there_and_back(a, b, sos) for a, b, sos in zip(names, names[1:], sections)], names[-1])


def _listed(tables: list[str], last: str) -> str:
    return f"WITH RECURSIVE {FR}, {', '.join(tables)} SELECT rec_id, unnest(range(len(x)))::BIGINT AS idx, round(unnest(x), 6) + 0.0::DOUBLE AS v FROM {last}"


def _taps_sql(up: int, down: int) -> str:
    """Polyphase resampling as sums of the taps that meet a sample."""
    half, taps = fl.resample_taps(up, down)
    n = -(-N * up // down)
    listed = "[" + ", ".join(f"{float(t)!r}::DOUBLE" for t in taps) + "]"
    row = f"list_sum(list_transform(range({N}), lambda k: CASE WHEN j * {down} - k * {up} BETWEEN {-half} AND {half} THEN x[k + 1] * t[j * {down} - k * {up} + {half + 1}] ELSE 0 END))"
    return _listed([f"tp AS (SELECT {listed} AS t)", f"rs AS (SELECT rec_id, list_transform(range({n}), lambda j: {row}) AS x FROM fr, tp)"], "rs")


def _spectrum_sql(gain: list[float], value: str, n: int = N, scale: float = 1 / N, centred: bool = False) -> str:
    """Fourier sums of a frame, times a gain for each frequency, and the sums back at n places: a is real, b imaginary."""
    angle = lambda i, of: f"2 * pi() * k * {i} / {of}"
    v = "v - avg(v) OVER (PARTITION BY rec_id)" if centred else "v"
    return f"""WITH {FR}, g AS (SELECT unnest(range({len(gain)})) AS k, unnest([{", ".join(f"{float(x)!r}::DOUBLE" for x in gain)}]) AS g), fs AS (SELECT rec_id, i, {v} AS v FROM (SELECT rec_id, unnest(range({N})) AS i, unnest(x) AS v FROM fr)),
ft AS (SELECT rec_id, k, any_value(g) * sum(v * cos({angle("i", N)})) AS re, -any_value(g) * sum(v * sin({angle("i", N)})) AS im FROM fs, g GROUP BY ALL),
bk AS (SELECT rec_id, j, {scale!r}::DOUBLE * sum(re * cos({angle("j", n)}) - im * sin({angle("j", n)})) AS a, {scale!r}::DOUBLE * sum(re * sin({angle("j", n)}) + im * cos({angle("j", n)})) AS b FROM ft, range({n}) t(j) GROUP BY ALL)
SELECT rec_id, j::BIGINT AS idx, round({value}, 6) + 0.0::DOUBLE AS v FROM bk"""


def _stationary_sql(level: int) -> str:
    """Detail of one level of the undecimated transform: sums of taps over places that wrap around."""
    low = np.array(fl.DB3[::-1])
    high = low[::-1] * np.where(np.arange(len(low)) % 2, -1, 1)
    tables, last = [], "fr"
    for i in range(level):
        taps = high if i == level - 1 else low
        row = " + ".join(f"{float(c)!r}::DOUBLE * x[(n + {k << i}) % {N} + 1]" for k, c in enumerate(taps))
        tables.append(f"w{i} AS (SELECT rec_id, list_transform(range({N}), lambda n: ({row}) / sqrt(2)) AS x FROM {last})")
        last = f"w{i}"
    return _listed(tables, last)


def _filter(name: str, kernel, sql: str | None = None):
    def f(spark: SparkSession, sf: str) -> DataFrame:
        return _values(D.filtered(_frames(spark, sf), kernel))

    f.__name__ = name
    query(sql)(f)


_notch = lambda *f: [fl.notch(x, 30.0, RATE) for x in f]
_filter("sig01_notch", D.notch(15.0), _chain(*_notch(15.0)))
_filter("sig02_notch_comb", D.notch_comb(10.0), _chain(*_notch(10.0, 20.0)))
_filter("sig03_bandpass", D.bandpass(0.5, 20.0), _chain(fl.butter(4, 0.5, 20.0, RATE)))
_filter("sig04_ecg_filter", D.ecg_filter(0.5, 20.0, 10.0), _chain(fl.butter(2, 0.5, None, RATE), *_notch(10.0, 20.0), fl.butter(2, None, 20.0, RATE)))
_filter("sig05_ppg_filter", D.ppg_filter())
_filter("sig05_ppg_filter_robust", D.ppg_filter(**D.ROBUST_PPG))
_filter("sig07_causal_filter", lambda x, fs: fl.run(fl.butter(2, 5, 15, fs), x), _listed([_cascade("fr", "y", fl.butter(2, 5, 15, RATE))], "y"))
_filter("sig08_envelope", lambda x, fs: fl.envelope(x - x.mean(axis=1, keepdims=True)), _spectrum_sql([1.0] + [2.0] * 31 + [1.0] + [0.0] * 31, "sqrt(a * a + b * b)", centred=True))
_filter("sig13_morlet_band", lambda x, fs: fl.morlet_band(x, fs, 0.5, 20.0), _spectrum_sql(fl.morlet_gain(N, RATE, 0.5, 20.0).tolist(), "a"))
_filter("sig14_wavelet_denoise", lambda x, fs: fl.denoise(x))
_filter("sig15_stationary_wavelet", lambda x, fs: fl.stationary_details(x, fl.DB3, 3)[2], _stationary_sql(3))
_filter("fill05_polyphase_resample", lambda x, fs: fl.resample_ratio(x, 3, 2), _taps_sql(3, 2))
_filter("fill06_fft_resample", lambda x, fs: fl.resample_fft(x, x.shape[1] // 2), _spectrum_sql([1.0] + [2.0] * 15 + [2.0], "a", n=N // 2))
_filter("pre02_resample_then_filter", D.resampled(D.ppg_filter(), 100.0))


@query()
def pre01_preprocessed(spark: SparkSession, sf: str) -> DataFrame:
    """Every frame filled, notched, band-passed, without its baseline and upright, and the steps that did it."""
    x = _frames(spark, sf).withColumn("x", F.transform("x", lambda v, i: F.when((i + F.col("rec_id")) % 7 == 0, None).otherwise(v)))
    done = D.preprocessed(x, D.Preprocess(notch=15.0, band=(0.5, 20.0)))
    return done.select("rec_id", "steps", "inverted", F.posexplode("x").alias("idx", "v")).withColumn("v", F.round("v", 6))


@query()
def pre03_pipelines(spark: SparkSession, sf: str) -> DataFrame:
    """The three pipelines side by side."""
    parts = [_values(D.filtered(_frames(spark, sf), k)).withColumnRenamed("v", name) for name, k in D.PIPELINES.items()]
    return parts[0].join(parts[1], ["rec_id", "idx"]).join(parts[2], ["rec_id", "idx"])


#: Samples of a frame of the detectors' signals, a minute, and of its halo on either side, ten seconds in which levels settle.
SIZE, HALO = int(60 * RATE), int(10 * RATE)


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    """Frames with halos of every supplier's series, at 50 Hz; rec_id names the frame, too."""
    s = D.frame(samples(spark, sf).select("rec_id", "idx", "v"), RATE, SIZE, HALO)
    return s.withColumn("rec_id", F.struct("rec_id", "frame_idx", "start_idx"))


def _own_peaks(found: DataFrame) -> DataFrame:
    """Beats with their place in the whole series, each from the frame that it lies in, not from a halo."""
    rows = found.select("rec_id.*", *[c for c in found.columns if c not in ("rec_id", "peaks")], F.explode("peaks").alias("p"))
    return rows.withColumn("peak_idx", F.col("start_idx") + F.col("p")).where(F.floor(F.col("peak_idx") / SIZE) == F.col("frame_idx")).drop("frame_idx", "start_idx", "p")


@query()
def det01_det14_all_detectors(spark: SparkSession, sf: str) -> DataFrame:
    """Beats of every detector in every series, and a row without a beat, but with the error, for a frame where one fails."""
    methods = {m: k for m, k in D.REGISTRY.items() if k}
    found = D.detect_all(_signals(spark, sf), methods)
    failed = found.where("error is not null").select("rec_id.rec_id", "detector", "error", F.lit(None).cast("long").alias("peak_idx"))
    return _own_peaks(found).select("rec_id", "detector", "error", "peak_idx").unionByName(failed)


@query()
def det16_front_end(spark: SparkSession, sf: str) -> DataFrame:
    """Beats of one detector without those of unusual height."""
    return _own_peaks(D.detect(_signals(spark, sf), "front_end", D.front_end(D.pan_tompkins_full))).select("rec_id", "detector", "peak_idx")


@query(f"""WITH {SM}, st AS (SELECT rec_id, sum(c) / count(*) AS mean, stddev_pop(c) AS sd FROM sm GROUP BY rec_id),
b AS (SELECT rec_id, idx, c, lag(c) OVER w AS a, lead(c) OVER w AS z FROM sm WINDOW w AS (PARTITION BY rec_id ORDER BY idx)), g AS (SELECT *, sum((a IS NULL OR a <> c)::INT) OVER (PARTITION BY rec_id ORDER BY idx) AS run FROM b),
m AS (SELECT rec_id, (min(idx) + max(idx)) // 2 AS t, any_value(c) AS d FROM g JOIN st USING (rec_id) GROUP BY rec_id, run HAVING coalesce(bool_or(a < c), false) AND coalesce(bool_or(z < c), false) AND any_value(c) >= any_value(mean)),
i AS (SELECT *, sum(far) OVER (PARTITION BY rec_id ORDER BY t) AS island FROM (SELECT *, coalesce((t - lag(t) OVER (PARTITION BY rec_id ORDER BY t) >= 5)::INT, 1) AS far FROM m)),
c AS (SELECT rec_id, island, list({{'d': d, 't': t}} ORDER BY d DESC, t DESC) AS xs FROM i GROUP BY ALL),
h AS (SELECT rec_id, unnest(list_reduce(list_transform(xs, lambda x: [x]), lambda kept, x: CASE WHEN len(list_filter(kept, lambda y: abs(y.t - x[1].t) < 5)) > 0 THEN kept ELSE list_concat(kept, x) END)) AS x FROM c),
p AS (SELECT rec_id, x.t AS t, x.d AS d FROM h), e AS (SELECT p.rec_id, t, d, max(idx) FILTER (idx < t AND c > d) AS lo, min(idx) FILTER (idx > t AND c > d) AS hi FROM p JOIN sm USING (rec_id) GROUP BY ALL),
q AS (SELECT e.rec_id, t, d, min(c) FILTER (idx <= t AND idx > coalesce(lo, -1)) AS lm, min(c) FILTER (idx >= t AND idx < coalesce(hi, 1e18)) AS rm FROM e JOIN sm USING (rec_id) GROUP BY e.rec_id, t, d)
SELECT q.rec_id, t::BIGINT AS peak_idx, (d - greatest(lm, rm)) / 100 AS prominence FROM q JOIN st USING (rec_id) WHERE d - greatest(lm, rm) >= sd""")
def pk01_find_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """Local maxima of whole recordings over their mean, five samples apart, as prominent as their spread."""
    s = samples(spark, sf).select("rec_id", "idx", F.col("c").alias("v"))
    spread = s.groupBy("rec_id").agg((F.sum("v") / F.count("*")).alias("mean"), F.stddev_pop("v").alias("sd"))
    high = K.local_maxima(s).join(spread, "rec_id").where("v >= mean").select("rec_id", "idx", "v")
    found = K.prominences(s, K.spaced(high, 5)).join(spread, "rec_id").where("prominence >= sd")
    return found.select("rec_id", F.col("idx").alias("peak_idx"), (F.col("prominence") / 100).alias("prominence"))


@query(f"""WITH {SM}, st AS (SELECT rec_id, sum(c) / count(*) AS mean, count(*) AS n FROM sm GROUP BY rec_id), ap AS (SELECT rec_id, idx AS t, c AS d FROM (SELECT *, lag(c) OVER w AS a, lead(c) OVER w AS z FROM sm WINDOW w AS (PARTITION BY rec_id ORDER BY idx)) JOIN st USING (rec_id) WHERE c > a AND c > z AND c >= mean),
ai AS (SELECT *, sum(far) OVER (PARTITION BY rec_id ORDER BY t) AS island FROM (SELECT *, coalesce((t - lag(t) OVER (PARTITION BY rec_id ORDER BY t) >= 25)::INT, 1) AS far FROM ap)), ac AS (SELECT rec_id, island, list({{'d': d, 't': t}} ORDER BY d DESC, t DESC) AS xs FROM ai GROUP BY ALL),
bt AS (SELECT rec_id, x.t AS beat FROM (SELECT rec_id, unnest(list_reduce(list_transform(xs, lambda x: [x]), lambda kept, x: CASE WHEN len(list_filter(kept, lambda y: abs(y.t - x[1].t) < 25)) > 0 THEN kept ELSE list_concat(kept, x) END)) AS x FROM ac)),
nb AS (SELECT rec_id, beat, row_number() OVER w AS k, lead(beat) OVER w AS nx, lead(beat, 5) OVER w AS ending FROM bt WINDOW w AS (PARTITION BY rec_id ORDER BY beat)),
zn AS (SELECT sm.rec_id, beat, k, idx, c FROM nb JOIN sm ON sm.rec_id = nb.rec_id AND idx >= beat + 10 AND idx < least(beat + 25, nx - 10)),
zp AS (SELECT rec_id, beat, k, idx AS t, c AS d FROM (SELECT *, lag(c) OVER w AS a, lead(c) OVER w AS z FROM zn WINDOW w AS (PARTITION BY rec_id, beat ORDER BY idx)) WHERE c > a AND c > z),
ze AS (SELECT p.rec_id, p.beat, p.k, t, d, max(idx) FILTER (idx < t AND c > d) AS lo, min(idx) FILTER (idx > t AND c > d) AS hi FROM zp p JOIN zn USING (rec_id, beat) GROUP BY ALL),
zq AS (SELECT e.rec_id, e.k, t, d - greatest(min(c) FILTER (idx <= t AND idx > coalesce(lo, -1)), min(c) FILTER (idx >= t AND idx < coalesce(hi, 1e18))) AS prom FROM ze e JOIN zn USING (rec_id, beat) GROUP BY e.rec_id, e.k, t, d),
tp AS (SELECT nb.rec_id, nb.k, max(c) AS top FROM nb JOIN sm ON sm.rec_id = nb.rec_id AND idx >= beat AND idx < coalesce(nx, 1e18) GROUP BY ALL),
sr AS (SELECT nb.rec_id, k, beat AS start, ending, max(top) OVER (PARTITION BY nb.rec_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) * 0.05 AS bar FROM nb JOIN tp USING (rec_id, k)),
ct AS (SELECT s.rec_id, s.k, s.start, s.ending, count(*) AS n, min(t) AS first FROM sr s JOIN zq ON zq.rec_id = s.rec_id AND zq.k BETWEEN s.k AND s.k + 3 WHERE prom >= bar AND ending IS NOT NULL GROUP BY ALL),
bs AS (SELECT rec_id, arg_max({{'s': start, 'e': ending, 'n': n, 'f': first}}, {{'n': n, 's': -start}}) AS b FROM ct GROUP BY rec_id)
SELECT st.rec_id, coalesce(b.s, 0)::BIGINT AS start, coalesce(b.e, least(250, n))::BIGINT AS "end", coalesce(b.n, 0)::BIGINT AS n_secondary, b.f::BIGINT AS first FROM st LEFT JOIN bs USING (rec_id)""")
def win25_twave_region(spark: SparkSession, sf: str) -> DataFrame:
    """The stretch of five intervals of each series in which secondary peaks stand out most; beats are maxima half a second apart."""
    s = samples(spark, sf).select("rec_id", "idx", F.col("c").alias("v"))
    mean = s.groupBy("rec_id").agg((F.sum("v") / F.count("*")).alias("mean"), F.count("*").alias("n"))
    beats = K.spaced(K.local_maxima(s).join(mean, "rec_id").where("v >= mean").select("rec_id", "idx", "v"), 25).select("rec_id", "idx")
    return T.prominent_stretch(s, beats, RATE, lengths=mean)


@query()
def aug02_to_aug15_augmented(spark: SparkSession, sf: str) -> DataFrame:
    """Noisy versions of every frame with the log of what was done to each."""
    x = frames(spark, sf).select("rec_id", F.lit(RATE).alias("fs"), "x")
    done = A.augment(x, seed=42)
    return done.select("rec_id", "log", F.size("noisy").alias("n"), F.round(F.aggregate("noisy", F.lit(0.0), lambda a, v: a + v * v), 6).alias("energy"), "noisy")


@query()
def aug12_jittered_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of 50 samples about every 40th sample, moved by a random jitter, with their largest sample."""
    s = samples(spark, sf).select("rec_id", "idx", "v")
    return A.jittered_windows(s, every=40, size=50, jitter=20, seed=42).select("rec_id", "start", F.size("x").alias("n"), F.round(F.array_max("x"), 4).alias("top"), "x")


#: Autocorrelations of two kinds of noise, for the recursion of three steps.
LPC = f"""{SM}, nz AS (SELECT rec_id, rec_id % 2 AS kind, idx, (c - avg(c) OVER (PARTITION BY rec_id)) / 100 AS v FROM sm), lg AS (SELECT *, lag(v) OVER w AS l1, lag(v, 2) OVER w AS l2, lag(v, 3) OVER w AS l3 FROM nz WINDOW w AS (PARTITION BY rec_id ORDER BY idx)),
ac AS (SELECT kind, count(*) AS n, sum(v * v) / sum(v * v) AS a, sum(v * l1) / sum(v * v) AS b, sum(v * l2) / sum(v * v) AS c, sum(v * l3) / sum(v * v) AS d FROM lg GROUP BY kind)"""


def _noise(spark: SparkSession, sf: str) -> DataFrame:
    # the mean by a window and lags in the order of the line items: one sort, where a join and an order by idx take three
    s = samples(spark, sf, *(c for c in ORDER if c not in ("l_orderkey", "l_partkey")))
    mean = F.avg("c").over(Window.partitionBy("rec_id"))
    return s.select("rec_id", (F.col("rec_id") % 2).alias("kind"), "idx", ((F.col("c") - mean) / 100).alias("v"), *ORDER)


@query(f"""WITH {LPC}, s AS (SELECT kind, n, b, c, d, 1 - b * b AS e1 FROM ac), k AS (SELECT *, (c - b * b) / e1 AS k2 FROM s), m AS (SELECT *, b - k2 * b AS p1, k2 AS p2, e1 * (1 - k2 * k2) AS e2 FROM k), z AS (SELECT *, (d - p1 * c - p2 * b) / e2 AS k3 FROM m)
SELECT kind, n, round(p1 - k3 * p2, 6) AS a1, round(p2 - k3 * p1, 6) AS a2, round(k3, 6) AS a3 FROM z""")
def aug04_noise_model(spark: SparkSession, sf: str) -> DataFrame:
    """Predictors of two kinds of noise, from sums over all their records."""
    return NZ.predictors(_noise(spark, sf), ORDER).select("kind", "n", *[F.round(F.col("a")[i], 6).alias(f"a{i + 1}") for i in range(NZ.ORDER)])


@query()
def aug04_noise_at_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Frames with noise of either kind at 6 dB: the samples, and the ratio as measured."""
    x = frames(spark, sf).select("rec_id", (F.col("rec_id") % 2).alias("kind"), "x")
    noisy = NZ.with_noise(x, NZ.fit(_noise(spark, sf), ORDER), 6.0)
    power = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)
    got = noisy.join(x.drop("kind"), "rec_id").withColumn("snr", 10 * F.log10(power("x") / power(F.zip_with("noisy", "x", lambda a, b: a - b))))
    return got.select("rec_id", "kind", F.round("snr", 3).alias("snr_db"), "noisy")


@query()
def aug14_weak_lead_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Frames as windows of a weak lead, noisy, with their truth maps."""
    crests = lambda x: F.filter(F.sequence(F.lit(1), F.size(x) - 2), lambda i: (F.get(x, i) > F.get(x, i - 1)) & (F.get(x, i) > F.get(x, i + 1)) & (F.get(x, i) > 0.15))
    x = frames(spark, sf).select("rec_id", "x", crests(F.col("x")).alias("peaks"))
    return NZ.weak_lead_windows(x, 100.0)
