"""SIG, XCO and SQI: spectra, lags, densities and signal quality of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import joins as J, periodogram as L, quality as Q, spectral as S, sync as Y, windowed as D, windows as W
from .aggregates import BINS, MOM, histogram_entropy
from .bindings import EV, FR, FS, LONG_EV, SG, SIGNAL_FS, SM, events, frame_samples, frames, long_events, samples, signals
from .registry import query
from .sequences import CLEAN, clean_rr, intervals

REC = "rec_id"
#: A frame of 64 samples counts as 1.28 s at 50 Hz.
RATE, SEGMENT = 50.0, 32


@query(f"""WITH {SM}, l AS (SELECT rec_id, regr_slope(v, idx) AS b, regr_intercept(v, idx) AS a FROM sm GROUP BY rec_id) SELECT rec_id, idx, round(v - (a + b * idx), 4) AS v FROM sm JOIN l USING (rec_id)""")
def sig06_linear_detrend(spark: SparkSession, sf: str) -> DataFrame:
    """Each series less its least-squares line."""
    s = samples(spark, sf).select(REC, "idx", "v")
    line = s.groupBy(REC).agg(F.regr_slope("v", "idx").alias("b"), F.regr_intercept("v", "idx").alias("a"))
    return s.join(line, REC).select(REC, "idx", F.round(F.col("v") - (F.col("a") + F.col("b") * F.col("idx")), 4).alias("v"))


WELCH = f"""sg AS (SELECT rec_id, s, i, (x[s + i + 1] - list_avg(x[s + 1 : s + 32])) * (0.5 - 0.5 * cos(2 * pi() * i / 32)) AS y FROM fr, range(0, 33, 16) t(s), range(32) u(i)),
ft AS (SELECT rec_id, s, k, sum(y * cos(2 * pi() * i * k / 32)) AS re, sum(y * sin(2 * pi() * i * k / 32)) AS im FROM sg, range(17) f(k) GROUP BY ALL),
ws AS (SELECT rec_id, k * 50.0 / 32 AS f, avg(CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END * (re * re + im * im) / (50.0 * (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * i / 32), 2)) FROM range(32) u(i)))) AS p FROM ft GROUP BY ALL)"""


def _trapezoid(cond: str, name: str) -> str:
    return f"{name} AS (SELECT rec_id, coalesce(sum(t), 0) AS {name} FROM (SELECT rec_id, (p + lag(p) OVER w) / 2 * (f - lag(f) OVER w) AS t FROM ws WHERE {cond} WINDOW w AS (PARTITION BY rec_id ORDER BY f)) GROUP BY rec_id)"


def _spectrum(spark: SparkSession, sf: str) -> DataFrame:
    return S.welch(frames(spark, sf), 64, RATE, SEGMENT)


@query(f"WITH {FR}, {WELCH} SELECT rec_id, f, round(p, 9) AS power FROM ws")
def sig09_welch_density(spark: SparkSession, sf: str) -> DataFrame:
    """Spectral density of each frame by Welch's method."""
    return _spectrum(spark, sf).select(REC, "f", F.round("power", 9).alias("power"))


BANDS_SQL = ", ".join([_trapezoid("true", "total"), _trapezoid("f >= 5 AND f <= 15", "qrs"), _trapezoid("(f < 5 OR f > 15) AND f <= 40", "noise"), _trapezoid("f >= 5 AND f <= 20", "qrs20"), _trapezoid("f >= 0.5 AND f <= 40", "wide"), _trapezoid("f >= 0.8 AND f <= 3", "pulse")])
JOIN_BANDS = "total JOIN qrs USING (rec_id) JOIN noise USING (rec_id) JOIN qrs20 USING (rec_id) JOIN wide USING (rec_id) LEFT JOIN pulse USING (rec_id)"


def _bands(spark: SparkSession, sf: str) -> DataFrame:
    f = F.col("f")
    return S.band_power(_spectrum(spark, sf), {"total": F.lit(True), "qrs": (f >= 5) & (f <= 15), "noise": ((f < 5) | (f > 15)) & (f <= 40), "qrs20": (f >= 5) & (f <= 20), "wide": (f >= 0.5) & (f <= 40), "pulse": (f >= 0.8) & (f <= 3)})


@query(f"WITH {FR}, {WELCH}, {BANDS_SQL} SELECT rec_id, round(total, 8) AS total, round(qrs, 8) AS qrs, round(noise, 8) AS noise, round(coalesce(pulse, 0), 8) AS pulse FROM {JOIN_BANDS}")
def sig10_band_power(spark: SparkSession, sf: str) -> DataFrame:
    """Power of bands as trapezoids between their frequencies."""
    return _bands(spark, sf).select(REC, *[F.round(c, 8).alias(c) for c in ("total", "qrs", "noise", "pulse")])


MOMENTS = f"""m AS (SELECT rec_id, {MOM} FROM fs GROUP BY rec_id), sk AS (SELECT rec_id, (m3 - 3 * m1 * m2 + 2 * pow(m1, 3)) / pow(m2 - m1 * m1, 1.5) AS skew, (m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * pow(m1, 4)) / pow(m2 - m1 * m1, 2) - 3 AS kurt FROM m)"""
SQI = f"""WITH {FS}, {WELCH}, {BANDS_SQL}, {MOMENTS}, e AS (SELECT rec_id, CASE WHEN wide > 0 THEN qrs20 / wide ELSE 0 END AS ratio, 10 * log10((qrs20 + 1e-12) / (wide - qrs20 + 1e-12)) AS snr, skew, kurt FROM {JOIN_BANDS} JOIN sk USING (rec_id)),
q AS (SELECT *, CASE WHEN kurt > 8 THEN 0.1 WHEN kurt > 5 THEN 0.4 WHEN kurt > 3 THEN 0.7 ELSE 0.9 END AS nk FROM e),
c AS (SELECT *, (CASE WHEN ratio >= 0.25 THEN 0.4 WHEN ratio >= 0.15 THEN 0.25 WHEN ratio > 0.1 THEN 0.1 ELSE 0 END) + (CASE WHEN snr > 0 THEN 0.2 WHEN snr > -5 THEN 0.15 WHEN snr > -10 THEN 0.05 ELSE 0 END) + (CASE WHEN kurt > 2.5 AND kurt < 8 THEN 0.2 WHEN kurt > 1.5 AND kurt < 12 THEN 0.1 ELSE 0 END) + (CASE WHEN nk > 0.7 THEN 0.2 WHEN nk > 0.4 THEN 0.1 WHEN nk > 0.2 THEN 0.05 ELSE 0 END) AS score FROM q)"""


def frame_sqi(spark: SparkSession, sf: str) -> DataFrame:
    """Every frame's QRS share, signal-to-noise ratio, skewness, kurtosis, template stand-in and composite score."""
    shape = frame_samples(spark, sf).groupBy(REC).agg(F.skewness("v").alias("skew"), F.kurtosis("v").alias("kurt"))
    ratio = F.when(F.col("wide") > 0, F.col("qrs20") / F.col("wide")).otherwise(0.0)
    snr = 10 * F.log10((F.col("qrs20") + 1e-12) / (F.col("wide") - F.col("qrs20") + 1e-12))
    e = _bands(spark, sf).select(REC, ratio.alias("ratio"), snr.alias("snr")).join(shape, REC).withColumn("nk", Q.from_kurtosis(F.col("kurt")))
    return e.withColumn("score", Q.composite(F.col("ratio"), F.col("snr"), F.col("kurt"), F.col("nk")))


@query(f"{SQI} SELECT rec_id, round(ratio, 6) AS qrs_energy_ratio, round(snr, 5) AS snr_db, round(skew, 6) AS skewness, round(kurt, 6) AS kurtosis FROM c")
def sqi01_qrs_band_energy(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the QRS band, its signal-to-noise ratio, skewness and kurtosis."""
    return frame_sqi(spark, sf).select(REC, F.round("ratio", 6).alias("qrs_energy_ratio"), F.round("snr", 5).alias("snr_db"), F.round("skew", 6).alias("skewness"), F.round("kurt", 6).alias("kurtosis"))


@query(f"{SQI} SELECT rec_id, nk::DOUBLE AS nk_sqi, round(score, 4)::DOUBLE AS score, CASE WHEN round(score, 4) >= 0.65 THEN 'good' WHEN round(score, 4) >= 0.35 THEN 'mediocre' ELSE 'poor' END AS quality_label, round(score, 4) >= 0.35 AS is_usable FROM c")
def sqi02_sqi03_sqi04_composite_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Score, label and use of each frame."""
    s = frame_sqi(spark, sf).withColumn("quality_label", Q.label(F.col("score")))
    return s.select(REC, F.col("nk").alias("nk_sqi"), F.round("score", 4).alias("score"), "quality_label", (F.col("quality_label") != "poor").alias("is_usable"))


#: Quality of windows of 200 samples every 100, with spectra of 40 samples every 20.
WSQI = f"""{SG}, sw AS (SELECT rec_id, unnest(range(0, (max(idx) + 1 - 200) // 100 + 1)) AS window_idx FROM sg GROUP BY rec_id HAVING max(idx) + 1 >= 200),
ss AS (SELECT sw.rec_id, window_idx, j, idx - window_idx * 100 - j * 20 AS i, v FROM sw, range(9) t(j) JOIN sg ON sg.rec_id = sw.rec_id AND idx >= window_idx * 100 + j * 20 AND idx < window_idx * 100 + j * 20 + 40),
sy AS (SELECT *, (v - avg(v) OVER (PARTITION BY rec_id, window_idx, j)) * (0.5 - 0.5 * cos(2 * pi() * i / 40)) AS y FROM ss), sf AS (SELECT rec_id, window_idx, j, k, sum(y * cos(2 * pi() * i * k / 40)) AS re, sum(y * sin(2 * pi() * i * k / 40)) AS im FROM sy, range(1, 21) f(k) GROUP BY ALL),
sp AS (SELECT rec_id, window_idx, k, avg(CASE WHEN k = 20 THEN 1 ELSE 2 END * (re * re + im * im) / (20.0 * (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * i / 40), 2)) FROM range(40) u(i)))) AS p FROM sf GROUP BY ALL),
sb AS (SELECT rec_id, window_idx, sum(t) AS total, sum(t) FILTER (k > 10) AS qrs, sum(t) FILTER (k < 10) AS noise FROM (SELECT *, (p + lag(p) OVER (PARTITION BY rec_id, window_idx ORDER BY k)) / 4 AS t FROM sp) GROUP BY ALL),
sm2 AS (SELECT rec_id, window_idx, sum(d * d) / 200 AS m2, sum(d * d * d) / 200 AS m3, sum(d * d * d * d) / 200 AS m4 FROM (SELECT sw.rec_id, window_idx, v - avg(v) OVER (PARTITION BY sw.rec_id, window_idx) AS d FROM sw JOIN sg ON sg.rec_id = sw.rec_id AND idx >= window_idx * 100 AND idx < window_idx * 100 + 200) GROUP BY ALL),
se AS (SELECT rec_id, window_idx, CASE WHEN total > 0 THEN qrs / total ELSE 0 END AS ratio, CASE WHEN noise > 0 THEN 10 * log10(qrs / noise) ELSE 0 END AS snr, CASE WHEN m2 > 0 THEN m4 / (m2 * m2) - 3 END AS kurt, CASE WHEN m2 > 0 THEN m3 / pow(m2, 1.5) END AS skew FROM sb JOIN sm2 USING (rec_id, window_idx)),
sn AS (SELECT *, CASE WHEN kurt > 8 THEN 0.1 WHEN kurt > 5 THEN 0.4 WHEN kurt > 3 THEN 0.7 ELSE 0.9 END AS nk FROM se),
sc AS (SELECT *, round((CASE WHEN ratio >= 0.25 THEN 0.4 WHEN ratio >= 0.15 THEN 0.25 WHEN ratio > 0.1 THEN 0.1 ELSE 0 END) + (CASE WHEN snr > 0 THEN 0.2 WHEN snr > -5 THEN 0.15 WHEN snr > -10 THEN 0.05 ELSE 0 END) + (CASE WHEN kurt > 2.5 AND kurt < 8 THEN 0.2 WHEN kurt > 1.5 AND kurt < 12 THEN 0.1 ELSE 0 END) + (CASE WHEN nk > 0.7 THEN 0.2 WHEN nk > 0.4 THEN 0.1 WHEN nk > 0.2 THEN 0.05 ELSE 0 END), 4)::DOUBLE AS score FROM sn),
wq AS (SELECT *, CASE WHEN score >= 0.65 THEN 'good' WHEN score >= 0.35 THEN 'mediocre' ELSE 'poor' END AS quality_label, score >= 0.35 AS is_usable FROM sc)"""


def signal_quality(spark: SparkSession, sf: str) -> DataFrame:
    return D.window_sqi(signals(spark, sf), SIGNAL_FS)


@query(f"""WITH {WSQI} SELECT rec_id, window_idx, window_idx * 100 AS start_sample, window_idx * 100 + 200 AS end_sample, window_idx * 5000 AS start_ms, window_idx * 5000 + 9950 AS end_ms, window_idx * 5000 + 5000 AS center_ms, round(ratio, 6) AS qrs_energy_ratio, round(snr, 5) AS snr_db, round(kurt, 6) AS kurtosis, round(skew, 6) AS skewness, nk::DOUBLE AS nk_sqi, score, quality_label, is_usable FROM wq""")
def sqi04_windowed_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of windows of 10 s every 5 s of whole recordings."""
    digits = {"qrs_energy_ratio": 6, "snr_db": 5, "kurtosis": 6, "skewness": 6, "score": 4}
    return signal_quality(spark, sf).withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(f"""WITH {EV}, {WSQI}, bt AS (SELECT rec_id, t_ms, lead(t_ms) OVER (PARTITION BY rec_id ORDER BY t_ms, peak_id) AS nx FROM ev),
bh AS (SELECT w.rec_id, window_idx, count(*) AS n_peaks, median(60000.0 / (nx - t_ms)) FILTER (nx < window_idx * 5000 + 10000 AND nx - t_ms > 240 AND nx - t_ms < 2000) AS hr FROM wq w JOIN bt b ON b.rec_id = w.rec_id AND t_ms >= window_idx * 5000 AND t_ms < window_idx * 5000 + 10000 WHERE is_usable GROUP BY ALL)
SELECT rec_id, window_idx, window_idx * 5000 AS start_ms, quality_label, is_usable, coalesce(n_peaks, 0) AS n_peaks, round(coalesce(hr, 0), 4)::DOUBLE AS hr_bpm FROM wq LEFT JOIN bh USING (rec_id, window_idx)""")
def sqi_gated_windowed_hr(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship plan: signal quality of every window, and beats and median rate of those of usable quality."""
    got = D.gated_windows(signal_quality(spark, sf), events(spark, sf), SIGNAL_FS)
    return got.select(REC, "window_idx", "start_ms", "quality_label", "is_usable", "n_peaks", F.round("hr_bpm", 4).alias("hr_bpm"))


@query(f"""WITH {SM}, g AS (SELECT rec_id, unnest(range(0, max(idx) + 1 - 100, 50)) AS s FROM sm GROUP BY rec_id), p AS (SELECT rec_id, avg(v) AS a, max(v) AS b FROM sm GROUP BY rec_id), n AS (SELECT sm.rec_id, idx, (v - a) / b AS v FROM sm JOIN p USING (rec_id)),
m AS (SELECT g.rec_id, s // 50 AS window_idx, {MOM} FROM g JOIN n ON n.rec_id = g.rec_id AND idx >= s AND idx < s + 100 GROUP BY ALL), k AS (SELECT rec_id, window_idx, (m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * pow(m1, 4)) / pow(m2 - m1 * m1, 2) - 3 AS k FROM m)
SELECT rec_id, window_idx, (CASE WHEN k > 8 THEN 0.1 WHEN k > 5 THEN 0.4 WHEN k > 3 THEN 0.7 ELSE 1.0 END)::DOUBLE AS stepped, round(greatest(0.1, least(1.0, 1 - (k - 2) / 10)), 5)::DOUBLE AS linear FROM k""")
def sqi05_kurtosis_sqi(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of each window from its kurtosis, in steps and on a line."""
    s = samples(spark, sf).select(REC, "idx", "v")
    n = s.groupBy(REC).agg(F.count("*").alias("n"))
    w = s.join(n, REC).withColumn("window_idx", F.explode(W.windows_of(F.col("idx"), 100, 50, W.full_windows(F.col("n"), 100, 50, False))))
    k = w.groupBy(REC, "window_idx").agg(F.kurtosis("v").alias("k"))
    return k.select(REC, "window_idx", Q.stepped(F.col("k")).alias("stepped"), F.round(Q.linear(F.col("k")), 5).alias("linear"))


ZCR = """z AS (SELECT rec_id, sum(d) / (2 * count(*)) AS zcr FROM (SELECT rec_id, abs(s - lag(s) OVER (PARTITION BY rec_id ORDER BY idx)) AS d FROM (SELECT rec_id, idx, sign(v - avg(v) OVER (PARTITION BY rec_id)) AS s FROM fs)) GROUP BY rec_id)"""
RULES = f"""WITH {FS}, {WELCH}, {BANDS_SQL}, {MOMENTS}, {ZCR}, {BINS}, h2 AS (SELECT rec_id, -sum(c / 64.0 * ln(c / 64.0)) AS ent FROM c GROUP BY rec_id),
r AS (SELECT rec_id, qrs / total AS share, 10 * log10(qrs / noise) AS snr, coalesce(pulse, 0) / total AS pshare, skew, kurt, zcr, ent FROM {JOIN_BANDS} JOIN sk USING (rec_id) JOIN z USING (rec_id) JOIN h2 USING (rec_id)),
s AS (SELECT *, (CASE WHEN share > 0.3 THEN 0.4 ELSE 0 END) + (CASE WHEN snr > 0 THEN 0.2 ELSE 0 END) + (CASE WHEN kurt > 3 THEN 0.2 ELSE 0 END) + (CASE WHEN zcr > 0 AND zcr < 0.2 THEN 0.2 ELSE 0 END) AS ecg,
 (CASE WHEN pshare > 0.5 THEN 0.4 ELSE 0 END) + (CASE WHEN abs(skew) > 0.5 THEN 0.2 ELSE 0 END) + (CASE WHEN ent < 4 THEN 0.2 ELSE 0 END) + (CASE WHEN kurt > 0 THEN 0.2 ELSE 0 END) AS ppg FROM r)"""


def _rules(spark: SparkSession, sf: str) -> DataFrame:
    s = frame_samples(spark, sf)
    c = s.withColumn("s", F.signum(F.col("v") - F.avg("v").over(Window.partitionBy(REC)))).withColumn("d", F.abs(F.col("s") - F.lag("s").over(W.by("idx"))))
    shape = c.groupBy(REC).agg(F.skewness("v").alias("skew"), F.kurtosis("v").alias("kurt"), (F.sum("d") / (2 * F.count("*"))).alias("zcr"))
    b = _bands(spark, sf).select(REC, (F.col("qrs") / F.col("total")).alias("share"), (10 * F.log10(F.col("qrs") / F.col("noise"))).alias("snr"), (F.col("pulse") / F.col("total")).alias("pshare"), "total")
    r = b.join(shape, REC).join(histogram_entropy(s.select(REC, "v")), REC)
    return r.withColumn("ecg", Q.ecg_rules(F.col("share"), F.col("snr"), F.col("kurt"), F.col("zcr"))).withColumn("ppg", Q.ppg_rules(F.col("pshare"), F.col("skew"), F.col("entropy"), F.col("kurt")))


@query(f"{RULES} SELECT rec_id, round(share, 6) AS ecg_rel_power_qrs, round(snr, 5) AS ecg_snr, round(zcr, 6) AS ecg_zcr, round(ecg, 3)::DOUBLE AS ecg_sqi_score, round(pshare, 6) AS ppg_rel_power, round(ent, 6) AS ppg_entropy, round(ppg, 3)::DOUBLE AS ppg_sqi_score FROM s")
def sqi06_sqi07_rule_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores by rules for electric and for optical signals."""
    r = lambda c, n, d: F.round(c, d).alias(n)
    return _rules(spark, sf).select(REC, r("share", "ecg_rel_power_qrs", 6), r("snr", "ecg_snr", 5), r("zcr", "ecg_zcr", 6), r("ecg", "ecg_sqi_score", 3), r("pshare", "ppg_rel_power", 6), r("entropy", "ppg_entropy", 6), r("ppg", "ppg_sqi_score", 3))


@query(f"{RULES} SELECT rec_id, round(ecg, 3) >= 0.2 AND kurt >= -1 AS ecg_pass, round(ppg, 3) >= 0.2 AND ent >= 1.5 AND abs(skew) >= 0.05 AND skew > 0 AS ppg_pass, round(ecg, 3) >= 0.2 AND kurt >= -1 AND round(ppg, 3) >= 0.2 AND ent >= 1.5 AND abs(skew) >= 0.05 AND skew > 0 AS is_good FROM s")
def sqi08_pass_fail_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Which rules a frame passes."""
    ecg = (F.round("ecg", 3) >= 0.2) & (F.col("kurt") >= -1)
    ppg = (F.round("ppg", 3) >= 0.2) & (F.col("entropy") >= 1.5) & (F.abs("skew") >= 0.05) & (F.col("skew") > 0)
    return _rules(spark, sf).select(REC, ecg.alias("ecg_pass"), ppg.alias("ppg_pass"), (ecg & ppg).alias("is_good"))


@query(f"{SQI} SELECT rec_id, CASE WHEN rec_id % 97 = 0 THEN NOT (round(score, 4) >= 0.35) WHEN kurt > -0.5 THEN round(score, 4) >= 0.4 ELSE round(score, 4) >= 0.35 END AS is_good FROM c")
def sqi10_sqi11_refined_and_overridden(spark: SparkSession, sf: str) -> DataFrame:
    """A stricter bar inside one class of frames, and a table of windows that were switched by hand."""
    s = frame_sqi(spark, sf).withColumn("score", F.round("score", 4))
    hand = frames(spark, sf).where("rec_id % 97 = 0").select(REC, F.lit(True).alias("switched"))
    usable = F.col("score") >= 0.35
    good = F.when(F.col("switched"), ~usable).when(F.col("kurt") > -0.5, F.col("score") >= 0.4).otherwise(usable)
    return s.join(hand, REC, "left").select(REC, good.alias("is_good"))


@query(f"""WITH {FR}, p AS (SELECT a.rec_id, a.x AS a, b.x AS b FROM fr a JOIN fr b ON b.rec_id = a.rec_id + 1), c AS (SELECT rec_id, list_transform(a, lambda v: pow(v - list_avg(a), 2)) AS a, list_transform(b, lambda v: pow(v - list_avg(b), 2)) AS b FROM p),
d AS (SELECT rec_id, list_transform(a, lambda v: v - list_avg(a)) AS a, list_transform(b, lambda v: v - list_avg(b)) AS b FROM c),
r AS (SELECT rec_id, k AS lag, sum(a[i + 1] * b[i + k + 1]) AS r FROM d, range(-10, 11) t(k), range(64) u(i) WHERE i + k BETWEEN 0 AND 63 GROUP BY ALL),
e AS (SELECT rec_id, sqrt(list_sum(list_transform(a, lambda v: v * v)) * list_sum(list_transform(b, lambda v: v * v))) + 1e-12 AS e FROM d)
SELECT rec_id, arg_max(lag, {{'r': round(r / e, 9), 'k': -lag}})::INTEGER AS lag, round(max(r / e), 6) AS r FROM r JOIN e USING (rec_id) GROUP BY rec_id""")
def xco01_polarity_invariant_lag(spark: SparkSession, sf: str) -> DataFrame:
    """The lag of best correlation between a frame and the next one; neighbours meet by an equi-join on the next id."""
    a = frames(spark, sf).select(REC, F.col("x").alias("a"))
    b = frames(spark, sf).select((F.col(REC) - 1).alias(REC), F.col("x").alias("b"))
    return Y.best_lag(a.join(b, REC), 64, 10).withColumn("r", F.round("r", 6))


@query(f"""WITH {FR}, p AS (SELECT a.rec_id, a.x AS a, b.x AS b FROM fr a JOIN fr b ON b.rec_id = a.rec_id + 1), r AS (SELECT rec_id, k AS lag, sum(a[i + k + 1] * b[i + 1]) AS r FROM p, range(-25, 25) t(k), range(64) u(i) WHERE i + k BETWEEN 0 AND 63 GROUP BY ALL),
e AS (SELECT rec_id, list_stddev_pop(a) * list_stddev_pop(b) * 64 + 1e-9 AS e FROM p) SELECT rec_id, arg_max(lag, {{'r': round(r / e, 9), 'k': -lag}})::INTEGER AS lag, round(max(r / e), 6) AS r FROM r JOIN e USING (rec_id) GROUP BY rec_id""")
def xco02_raw_fine_lag(spark: SparkSession, sf: str) -> DataFrame:
    """Lag of the plain samples within half a second either way, the upper end not tried."""
    a = frames(spark, sf).select(REC, F.col("x").alias("b"))
    b = frames(spark, sf).select((F.col(REC) - 1).alias(REC), F.col("x").alias("a"))
    return Y.best_lag(a.join(b, REC), 64, int(RATE / 2), "whole", closed=False).withColumn("r", F.round("r", 6))


LAG_SQL = """lg AS (SELECT rec_id, arg_max(lag, {'r': round(r / e, 9), 'k': -lag}) AS lag FROM r JOIN e USING (rec_id) GROUP BY rec_id)"""


@query(f"""WITH {FR}, p AS (SELECT a.rec_id, a.x AS a, b.x AS b FROM fr a JOIN fr b ON b.rec_id = a.rec_id + 1), c AS (SELECT rec_id, list_transform(a, lambda v: pow(v - list_avg(a), 2)) AS a, list_transform(b, lambda v: pow(v - list_avg(b), 2)) AS b FROM p),
d AS (SELECT rec_id, list_transform(a, lambda v: v - list_avg(a)) AS a, list_transform(b, lambda v: v - list_avg(b)) AS b FROM c),
r AS (SELECT rec_id, k AS lag, sum(a[i + 1] * b[i + k + 1]) AS r FROM d, range(-10, 11) t(k), range(64) u(i) WHERE i + k BETWEEN 0 AND 63 GROUP BY ALL),
e AS (SELECT rec_id, sqrt(list_sum(list_transform(a, lambda v: v * v)) * list_sum(list_transform(b, lambda v: v * v))) + 1e-12 AS e FROM d), {LAG_SQL},
g AS (SELECT p.rec_id, i, a[i + 1] AS ref, (i + lag) AS at_, b FROM p JOIN lg USING (rec_id), range(64) t(i) WHERE i + lag BETWEEN 0 AND 62)
SELECT rec_id, i / 50.0 AS x, round(ref, 6) AS ref, round(CASE WHEN at_ % 2 = 0 THEN b[at_ + 1] WHEN i = 0 THEN b[at_ + 2] WHEN i = 63 THEN b[at_] ELSE (b[at_] + b[at_ + 2]) / 2 END, 6) AS other FROM g""")
def xco03_synchronised(spark: SparkSession, sf: str) -> DataFrame:
    """The next frame, of which every second sample is there, moved by the lag of both and read at this frame's samples."""
    s = frame_samples(spark, sf)
    a = frames(spark, sf).select(REC, F.col("x").alias("a"))
    b = frames(spark, sf).select((F.col(REC) - 1).alias(REC), F.col("x").alias("b"))
    shift = Y.best_lag(a.join(b, REC), 64, 10).select(REC, (F.col("lag") / RATE).alias("shift"))
    other = s.where("idx % 2 = 0").select((F.col(REC) - 1).alias(REC), (F.col("idx") / RATE).alias("x"), "v")
    # places in whole samples, so that both sides meet on the same ones
    at = lambda df: df.withColumn("x", F.round(F.col("x") * RATE))
    found = Y.aligned(at(s.select(REC, (F.col("idx") / RATE).alias("x"), "v")), at(other), shift.withColumn("shift", F.round(F.col("shift") * RATE)))
    return found.select(REC, (F.col("x") / RATE).alias("x"), F.round("ref", 6).alias("ref"), F.round("other", 6).alias("other"))


@query(f"""WITH {FR}, p AS (SELECT a.rec_id, a.x AS a, b.x AS b FROM fr a JOIN fr b ON b.rec_id = a.rec_id + 1), w AS (SELECT rec_id, s // 16 AS window_idx, a[s + 1 : s + 32] AS a, b[s + 1 : s + 32] AS b FROM p, range(0, 33, 16) t(s)),
d AS (SELECT rec_id, window_idx, list_transform(a, lambda v: v - list_avg(a)) AS a, list_transform(b, lambda v: v - list_avg(b)) AS b FROM w), r AS (SELECT rec_id, window_idx, k AS lag, sum(a[i + 1] * b[i + k + 1]) AS r FROM d, range(-5, 6) t(k), range(32) u(i) WHERE i + k BETWEEN 0 AND 31 GROUP BY ALL)
SELECT rec_id, window_idx::INTEGER AS window_idx, arg_max(lag, {{'r': round(r, 9), 'k': -lag}})::INTEGER AS lag FROM r GROUP BY ALL""")
def win22_windowed_lag_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Lag of a frame and the next one in each of three windows."""
    a = frames(spark, sf).select(REC, F.col("x").alias("a"))
    b = frames(spark, sf).select((F.col(REC) - 1).alias(REC), F.col("x").alias("b"))
    parts = F.array(*[F.struct(F.lit(i).alias("k"), F.slice("a", s + 1, 32).alias("a"), F.slice("b", s + 1, 32).alias("b")) for i, s in enumerate((0, 16, 32))])
    w = a.join(b, REC).select(REC, F.explode(parts).alias("w")).select(F.struct(F.col(REC).alias("rec"), F.col("w.k").alias("k")).alias(REC), "w.a", "w.b")
    # correlation without the energies, as both are fixed within a window
    r = S.xcorr(w, 32, 5, "raw")
    e = F.struct(F.round("r", 9).alias("r"), (-F.col("lag")).alias("k"))
    return r.groupBy(REC).agg(F.max_by("lag", e).alias("lag")).select(F.col("rec_id.rec").alias(REC), F.col("rec_id.k").alias("window_idx"), "lag")


#: Fixed values of the interval spectrum: window and step in ms, least number of intervals, frequencies, bands in Hz.
SPAN_MS, STEP_MS, LEAST = 300_000, 30_000, 100
GRID = (0.001, 0.4, 1000)
BANDS = {"vlf": (0.0033, 0.04), "lf": (0.04, 0.15), "hf": (0.15, 0.4)}
#: Keeps the grid's last frequency, 0.4, out of the band that ends there.
END = 1e-9
LONG = CLEAN.replace(EV, LONG_EV)
SINES = """sum(y - m) AS y0, sum(cos(w * t)) AS c, sum(sin(w * t)) AS s, sum(cos(w * t) * cos(w * t)) AS cc, sum(sin(w * t) * sin(w * t)) AS ss, sum(cos(w * t) * sin(w * t)) AS cs, sum((y - m) * cos(w * t)) AS yc, sum((y - m) * sin(w * t)) AS ys"""


def _power_sql(cc: str, ss: str, cs: str) -> str:
    """The periodogram from sums, rotated to where sine and cosine are orthogonal."""
    rotated = f"SELECT *, {cc} AS a, {ss} AS b, {cs} AS d, atan2(2 * ({cs}), ({cc}) - ({ss})) / 2 AS u FROM sn"
    return f"""SELECT *, (pow(yc * cos(u) + ys * sin(u), 2) / (a * pow(cos(u), 2) + 2 * d * cos(u) * sin(u) + b * pow(sin(u), 2)) + pow(ys * cos(u) - yc * sin(u), 2) / (b * pow(cos(u), 2) - 2 * d * cos(u) * sin(u) + a * pow(sin(u), 2))) / 2 AS p FROM ({rotated})"""


def _band_sql(name: str) -> str:
    lo, hi = BANDS[name]
    return f"coalesce(sum(CASE WHEN pf >= {lo} AND f < {hi} - {END} THEN (p + pp) / 2 * (f - pf) END), 0) AS {name}"


@query(f"""{LONG}, o AS (SELECT rec_id, peak_id, t_ms, clean, row_number() OVER (PARTITION BY rec_id ORDER BY t_ms, peak_id) AS idx FROM k), e AS (SELECT rec_id, min(t_ms) AS t0, max(t_ms) AS t1 FROM k GROUP BY rec_id),
g AS (SELECT rec_id, t0, unnest(range(0, (t1 - t0 - {SPAN_MS}) // {STEP_MS} + 1)) AS win FROM e WHERE t1 - t0 >= {SPAN_MS}),
pt AS (SELECT g.rec_id, win, (t_ms - t0) / 1000.0 AS t, clean::DOUBLE AS y FROM g JOIN k ON k.rec_id = g.rec_id AND t_ms >= t0 + win * {STEP_MS} AND t_ms < t0 + win * {STEP_MS} + {SPAN_MS} WHERE clean IS NOT NULL),
ok AS (SELECT rec_id, win, avg(y) AS m FROM pt GROUP BY ALL HAVING count(*) > {LEAST}), fq AS (SELECT i, {GRID[0]}::DOUBLE + i * ({GRID[1]}::DOUBLE - {GRID[0]}::DOUBLE) / {GRID[2] - 1} AS f FROM range({GRID[2]}) t(i)),
sn AS (SELECT pt.rec_id, pt.win, i, any_value(f) AS f, {SINES} FROM (SELECT pt.*, m, i, f, 2 * pi() * f AS w FROM pt JOIN ok USING (rec_id, win), fq) pt GROUP BY pt.rec_id, pt.win, i), ps AS ({_power_sql("cc", "ss", "cs")}),
bp AS (SELECT rec_id, win, {", ".join(map(_band_sql, BANDS))} FROM (SELECT *, lag(f) OVER w AS pf, lag(p) OVER w AS pp FROM ps WINDOW w AS (PARTITION BY rec_id, win ORDER BY i)) GROUP BY ALL),
md AS (SELECT bp.rec_id, win, min(idx) AS idx, any_value(CASE WHEN hf > 0 THEN lf / hf END) AS ratio, any_value(vlf + lf + hf) AS tp FROM bp JOIN e USING (rec_id) JOIN o ON o.rec_id = bp.rec_id AND o.t_ms >= t0 + win * {STEP_MS} + {SPAN_MS // 2} GROUP BY ALL),
at_ AS (SELECT rec_id, idx, arg_max(ratio, win) AS ratio, arg_max(tp, win) AS tp FROM md GROUP BY ALL), s AS (SELECT o.rec_id, peak_id, o.idx, ratio, tp FROM o LEFT JOIN at_ USING (rec_id, idx)),
a AS (SELECT *, last_value(CASE WHEN tp IS NOT NULL THEN {{'i': idx, 'r': ratio, 't': tp}} END IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY idx) AS b, first_value(CASE WHEN tp IS NOT NULL THEN {{'i': idx, 'r': ratio, 't': tp}} END IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM s)
SELECT rec_id, peak_id, round(CASE WHEN b.i = n.i THEN b.r WHEN b IS NULL THEN n.r WHEN n IS NULL THEN b.r ELSE b.r + (n.r - b.r) * (idx - b.i) / (n.i - b.i) END, 6) AS hrv_lfhf, round(CASE WHEN b.i = n.i THEN b.t WHEN b IS NULL THEN n.t WHEN n IS NULL THEN b.t ELSE b.t + (n.t - b.t) * (idx - b.i) / (n.i - b.i) END, 3) AS hrv_tp FROM a""")
def sig11_lomb_scargle_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Band powers of the interval series in windows of 300 s every 30 s that hold over 100 intervals, given to the first beat at
    or after a window's middle and filled on the line between."""
    from ..operators import fills

    beats = clean_rr(intervals(long_events(spark, sf)))
    ends = beats.groupBy(REC).agg(F.min("t_ms").alias("t0"), F.max("t_ms").alias("t1")).withColumn("count", W.full_windows(F.col("t1") - F.col("t0"), SPAN_MS, STEP_MS))
    points = beats.where("clean is not null").join(ends, REC).select(REC, (F.col("t_ms") - F.col("t0")).alias("t_ms"), F.col("clean").cast("double").alias("y"), "count")
    bands = {name: (lo, hi - END) for name, (lo, hi) in BANDS.items()}
    p = L.window_bands(points, L.Frequencies(GRID[0], (GRID[1] - GRID[0]) / (GRID[2] - 1), GRID[2]), SPAN_MS, STEP_MS, LEAST, bands)
    b = p.select(REC, "win", F.when(F.col("hf") > 0, F.try_divide("lf", "hf")).alias("ratio"), (F.col("vlf") + F.col("lf") + F.col("hf")).alias("tp"))
    # the windows whose middle lies after the beat before and not after this one, by their number
    mid = lambda t: F.floor((F.col(t) - F.col("t0") - SPAN_MS // 2) / STEP_MS)
    order = W.by("t_ms", "peak_id")
    rows = beats.select(REC, "peak_id", "t_ms", F.row_number().over(order).alias("idx"), F.lag("t_ms").over(order).alias("before"))
    first, last = F.greatest(F.coalesce(mid("before") + 1, F.lit(0)), F.lit(0)), F.least(mid("t_ms"), F.col("count") - 1)
    wins = rows.join(ends, REC).select(REC, "idx", F.explode(F.when(first <= last, F.sequence(first, last))).alias("win"))
    at = wins.join(b, [REC, "win"]).groupBy(REC, "idx").agg(F.max_by(F.struct("ratio", "tp"), "win").alias("x"))
    got = rows.join(at, [REC, "idx"], "left").select(REC, "peak_id", "idx", "x.ratio", "x.tp")
    got = fills.interpolate(got, v=["ratio", "tp"])
    return got.select(REC, "peak_id", F.round("ratio", 6).alias("hrv_lfhf"), F.round("tp", 3).alias("hrv_tp"))


#: Fixed values of the other spectrum: the grid's start and end in Hz, its places, and how many of them count.
WIDE, COUNTED = (0.01, 1.0, 1000), 500


@query(f"""{LONG}, e AS (SELECT rec_id, min(t_ms) AS t0 FROM k GROUP BY rec_id), pt AS (SELECT rec_id, (t_ms - t0) / 1000.0 AS t, rr / 1000.0 AS y, avg(rr / 1000.0) OVER (PARTITION BY rec_id) AS m FROM k JOIN e USING (rec_id) WHERE rr IS NOT NULL),
fq AS (SELECT i, {WIDE[0]}::DOUBLE + i * ({WIDE[1]}::DOUBLE - {WIDE[0]}::DOUBLE) / {WIDE[2]} AS f FROM range({COUNTED}) t(i)), sn AS (SELECT rec_id, i, any_value(f) AS f, count(*) AS n, {SINES} FROM (SELECT *, 2 * pi() * f AS w FROM pt, fq) GROUP BY ALL),
ps AS ({_power_sql("cc - c * c / n", "ss - s * s / n", "cs - c * s / n")}) SELECT rec_id, round(sum(p) FILTER (f >= 0.04 AND f <= 0.15) / sum(p) FILTER (f >= 0.15 AND f <= 0.4), 6) AS lf_hf FROM ps GROUP BY rec_id""")
def sig12_lomb_scargle_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Low over high band of all intervals in seconds, from the first half of a grid up to 1 Hz, a constant fitted too. Powers are
    summed, and their normalisation cancels out."""
    beats = intervals(long_events(spark, sf))
    ends = beats.groupBy(REC).agg(F.min("t_ms").alias("t0"))
    points = beats.where("rr is not null").join(ends, REC).select(REC, (F.col("t_ms") - F.col("t0")).alias("t_ms"), (F.col("rr") / 1000).alias("y"))
    freqs = L.Frequencies(WIDE[0], (WIDE[1] - WIDE[0]) / WIDE[2], COUNTED)
    p = L.whole_power(points, freqs, 3_600_000, floating=True).select(REC, F.posexplode("power").alias("i", "power")).withColumn("f", freqs.start + F.col("i") * freqs.step)
    total = lambda lo, hi: F.sum(F.when((F.col("f") >= lo - END) & (F.col("f") <= hi + END), F.col("power")))
    return p.groupBy(REC).agg(F.round(total(0.04, 0.15) / total(0.15, 0.4), 6).alias("lf_hf"))


@query(f"""WITH {FR}, e AS (SELECT rec_id, label, i, x[i * 8 + 1 : i * 8 + 8] AS y FROM fr, range(8) t(i)), u AS (SELECT rec_id, label, i, j, y[j + 1] AS v FROM e, range(8) t(j)), tm AS (SELECT rec_id, j, quantile_cont(v, 0.5) AS m FROM u GROUP BY ALL),
r AS (SELECT rec_id, i, corr(v, m) AS r FROM u JOIN tm USING (rec_id, j) GROUP BY ALL) SELECT rec_id, round(avg(greatest(0, r)), 6) AS template_sqi FROM r GROUP BY rec_id""")
def agg19_template_sqi(spark: SparkSession, sf: str) -> DataFrame:
    """Mean correlation of a frame's epochs with their median template."""
    u = frame_samples(spark, sf).select(REC, F.expr("idx div 8").alias("i"), F.expr("idx % 8").alias("j"), "v")
    tm = u.groupBy(REC, "j").agg(F.percentile("v", 0.5).alias("m"))
    r = u.join(tm, [REC, "j"]).groupBy(REC, "i").agg(F.corr("v", "m").alias("r"))
    return r.groupBy(REC).agg(F.round(F.avg(F.greatest(F.lit(0.0), F.col("r"))), 6).alias("template_sqi"))


#: Features of a window's optical and electric signal that clusters are made of.
CLUSTERED = ("ppg_skew", "ppg_kurtosis", "ppg_entropy", "ppg_rel_power", "ppg_zcr", "ppg_total_power", "ecg_skew", "ecg_kurtosis", "ecg_rel_power_qrs", "ecg_zcr", "ecg_total_power")


@query()
def sqi09_kmeans_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Frames in four clusters of eleven features; a frame's optical signal is the next frame."""
    from ..operators import clusters

    r = _rules(spark, sf)
    ecg = r.select(REC, F.col("skew").alias("ecg_skew"), F.col("kurt").alias("ecg_kurtosis"), F.col("share").alias("ecg_rel_power_qrs"), F.col("zcr").alias("ecg_zcr"), F.col("total").alias("ecg_total_power"))
    ppg = r.select((F.col(REC) - 1).alias(REC), F.col("skew").alias("ppg_skew"), F.col("kurt").alias("ppg_kurtosis"), F.col("entropy").alias("ppg_entropy"), F.col("pshare").alias("ppg_rel_power"), F.col("zcr").alias("ppg_zcr"), F.col("total").alias("ppg_total_power"))
    return clusters.kmeans(ecg.join(ppg, REC), list(CLUSTERED))
