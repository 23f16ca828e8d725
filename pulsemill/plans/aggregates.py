"""AGG, TOP and SET: summaries, errors, variability, scores, pivots and top rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import windows as W
from .bindings import EV, FR, FS, SM, events, frame_samples, peaks, samples
from .registry import query
from .sequences import RR, WHR, _rr, windowed_hr

REC = "rec_id"
T = f"WITH {EV}"


@query(f"""{WHR} SELECT rec_id, count(*) AS n_windows, count(*) FILTER (n_peaks >= 4) AS n_usable, round(100.0 * count(*) FILTER (n_peaks >= 4) / greatest(count(*), 1), 4) AS pct_usable,
 round(avg(hr_bpm) FILTER (hr_bpm > 0), 4) AS mean_hr, round(stddev_pop(hr_bpm) FILTER (hr_bpm > 0), 4) AS std_hr FROM whr GROUP BY rec_id""")
def agg01_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Windows, usable ones and the heart rate of each recording."""
    hr = F.when(F.col("hr_bpm") > 0, F.col("hr_bpm"))
    usable = F.count_if(F.col("n_peaks") >= 4)
    return windowed_hr(events(spark, sf)).groupBy(REC).agg(F.count("*").alias("n_windows"), usable.alias("n_usable"), F.round(100 * usable / F.greatest(F.count("*"), F.lit(1)), 4).alias("pct_usable"), F.round(F.avg(hr), 4).alias("mean_hr"), F.round(F.stddev_pop(hr), 4).alias("std_hr"))


PAIR = f"""{T}, a AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY t_ms, peak_id) AS k FROM ev WHERE event_type = 'click'), b AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY t_ms, peak_id) AS k FROM ev WHERE event_type = 'view'),
p AS (SELECT rec_id, a.value AS ref, b.value AS test, b.value - a.value AS e, round(b.value * 100) - round(a.value * 100) AS c FROM a JOIN b USING (rec_id, k))"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda k, c: peaks(spark, sf, k).withColumn("k", F.row_number().over(W.by("t_ms", "peak_id"))).select(REC, "k", F.col("value").alias(c))
    # c: the error in hundredths, whole numbers whose sums are exact in any order
    cents = F.round(F.col("test") * 100) - F.round(F.col("ref") * 100)
    return n("click", "ref").join(n("view", "test"), [REC, "k"]).withColumn("e", F.col("test") - F.col("ref")).withColumn("c", cents)


@query(f"""{PAIR} SELECT rec_id, avg(c) / 100 AS bias, round(stddev_pop(e), 5) AS sd, avg(abs(c)) / 100 AS mae, round(sqrt(avg(e * e)), 5) AS rmse, round(100 * avg(abs(e) / ref), 5) AS mape, round(quantile_cont(abs(e), 0.5), 5) AS median_ae FROM p GROUP BY rec_id""")
def agg02_error_block(spark: SparkSession, sf: str) -> DataFrame:
    """Error of the test's values against the reference's, pair by pair in order: bias, spread, absolute, squared and relative means, median."""
    e = F.col("e")
    r = lambda c, n: F.round(F.coalesce(c, F.lit(0.0)), 5).alias(n)
    # over a reference of zero an error is infinite, and none at all is no number, as in the SQL
    share = F.when(F.col("ref") != 0, F.abs(e) / F.col("ref")).when(F.col("ref") == 0, F.when(e != 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))
    return _pairs(spark, sf).groupBy(REC).agg(F.coalesce(F.avg("c") / 100, F.lit(0.0)).alias("bias"), r(F.stddev_pop(e), "sd"), F.coalesce(F.avg(F.abs("c")) / 100, F.lit(0.0)).alias("mae"), r(F.sqrt(F.avg(e * e)), "rmse"), r(100 * F.avg(share), "mape"), r(F.percentile(F.abs(e), 0.5), "median_ae"))


@query(f"""{PAIR} SELECT rec_id, avg(c) / 100 AS bias, round(avg(e) - 1.96 * stddev_samp(e), 5) AS lo_samp, round(avg(e) + 1.96 * stddev_samp(e), 5) AS hi_samp, round(avg(e) - 1.96 * stddev_pop(e), 5) AS lo_pop, round(avg(e) + 1.96 * stddev_pop(e), 5) AS hi_pop FROM p GROUP BY rec_id""")
def agg04_bland_altman(spark: SparkSession, sf: str) -> DataFrame:
    """Bias and limits of agreement, from the spread of a sample and of a population."""
    b, s, p = F.avg("e"), F.stddev_samp("e"), F.stddev_pop("e")
    return _pairs(spark, sf).groupBy(REC).agg((F.avg("c") / 100).alias("bias"), F.round(b - 1.96 * s, 5).alias("lo_samp"), F.round(b + 1.96 * s, 5).alias("hi_samp"), F.round(b - 1.96 * p, 5).alias("lo_pop"), F.round(b + 1.96 * p, 5).alias("hi_pop"))


@query(f"{PAIR} SELECT rec_id, count(*) AS n, round(corr(ref, test), 6) AS r FROM p GROUP BY rec_id HAVING count(*) > 2")
def agg05_pearson(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation of the pairs of recordings with three or more."""
    return _pairs(spark, sf).groupBy(REC).agg(F.count("*").alias("n"), F.round(F.corr("ref", "test"), 6).alias("r")).where("n > 2")


MOM = "avg(v) AS m1, avg(v * v) AS m2, avg(v * v * v) AS m3, avg(v * v * v * v) AS m4"


@query(f"""WITH {FS}, m AS (SELECT rec_id, {MOM} FROM fs GROUP BY rec_id) SELECT rec_id, round((m3 - 3 * m1 * m2 + 2 * pow(m1, 3)) / pow(m2 - m1 * m1, 1.5), 6) AS skew, round((m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * pow(m1, 4)) / pow(m2 - m1 * m1, 2) - 3, 6) AS kurt FROM m""")
def agg06_skew_kurtosis(spark: SparkSession, sf: str) -> DataFrame:
    """Population skewness and excess kurtosis of each frame."""
    return frame_samples(spark, sf).groupBy(REC).agg(F.round(F.skewness("v"), 6).alias("skew"), F.round(F.kurtosis("v"), 6).alias("kurt"))


@query(f"""WITH {FS}, c AS (SELECT rec_id, idx, sign(v - avg(v) OVER (PARTITION BY rec_id)) AS s FROM fs), d AS (SELECT rec_id, abs(s - lag(s) OVER (PARTITION BY rec_id ORDER BY idx)) AS d FROM c) SELECT rec_id, round(sum(d) / (2 * count(*)), 6) AS zcr FROM d GROUP BY rec_id""")
def agg07_zero_crossings(spark: SparkSession, sf: str) -> DataFrame:
    """Share of samples at which a frame less its mean changes sign."""
    c = frame_samples(spark, sf).withColumn("s", F.signum(F.col("v") - F.avg("v").over(Window.partitionBy(REC))))
    return c.withColumn("d", F.abs(F.col("s") - F.lag("s").over(W.by("idx")))).groupBy(REC).agg(F.round(F.sum("d") / (2 * F.count("*")), 6).alias("zcr"))


BINS = """q AS (SELECT rec_id, min(v) AS lo, max(v) AS hi, count(*) AS n, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM fs GROUP BY rec_id),
w AS (SELECT *, least((hi - lo) / (log2(n) + 1), CASE WHEN iqr > 0 THEN 2 * iqr / pow(n, 1.0 / 3) ELSE 1e300 END) AS width FROM q), b AS (SELECT *, ceil((hi - lo) / width)::BIGINT AS bins FROM w),
h AS (SELECT rec_id, bins, least(bins - 1, floor((v - lo) / (hi - lo) * bins)::BIGINT) AS bin FROM fs JOIN b USING (rec_id)), c AS (SELECT rec_id, bins, bin, count(*) AS c FROM h GROUP BY ALL)"""


def histogram_entropy(s: DataFrame) -> DataFrame:
    """rec_id, bins, entropy of the histogram whose bins are the finer of Sturges' and Freedman and Diaconis' rules."""
    q = s.groupBy(REC).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"), F.percentile("v", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    iqr = F.col("q")[1] - F.col("q")[0]
    width = F.least((F.col("hi") - F.col("lo")) / (F.log2("n") + 1), F.when(iqr > 0, 2 * iqr / F.pow(F.col("n"), F.lit(1 / 3))))
    q = q.withColumn("bins", F.ceil((F.col("hi") - F.col("lo")) / width))
    b = s.join(q, REC).withColumn("bin", F.least(F.col("bins") - 1, F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins"))))
    c = b.groupBy(REC, "bins", "n", "bin").count()
    p = F.col("count") / F.col("n")
    return c.groupBy(REC, "bins").agg((-F.sum(p * F.log(p))).alias("entropy"))


@query(f"WITH {FS}, {BINS} SELECT rec_id, bins, round(-sum(c / 64.0 * ln(c / 64.0)), 6) AS entropy FROM c GROUP BY ALL")
def agg08_histogram_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Entropy of the density over bins whose number the samples choose."""
    return histogram_entropy(frame_samples(spark, sf).select(REC, "v")).select(REC, "bins", F.round("entropy", 6).alias("entropy"))


@query(f"""{RR}, d AS (SELECT *, rr - lag(rr) OVER (PARTITION BY rec_id ORDER BY t_ms, peak_id) AS dd FROM rr),
sn AS (SELECT rec_id, greatest(1, floor(max(t_ms) / 18000 + 0.5)::BIGINT) AS sections FROM ev GROUP BY rec_id),
sec AS (SELECT rec_id, t_ms // 18000 AS s, (max(t_ms) - min(t_ms)) / (count(*) - 1) AS m FROM ev JOIN sn USING (rec_id) WHERE t_ms // 18000 < sections GROUP BY ALL HAVING count(*) > 1),
sd AS (SELECT rec_id, stddev_pop(m) AS sdann FROM sec GROUP BY rec_id)
SELECT rec_id, round(stddev_pop(rr), 5) AS sdnn, round(any_value(sdann), 5) AS sdann, round(sqrt(avg(dd * dd)), 5) AS rmssd, round(stddev_pop(dd), 5) AS sdsd, count(*) FILTER (abs(dd) > 50) AS nn50, round(count(*) FILTER (abs(dd) > 50) / (count(*) - 1), 6) AS pnn50,
 count(*) FILTER (abs(dd) > 20) AS nn20, round(count(*) FILTER (abs(dd) > 20) / (count(*) - 1), 6) AS pnn20, round(stddev_pop(rr) / avg(rr), 6) AS cv FROM d LEFT JOIN sd USING (rec_id) GROUP BY rec_id HAVING count(*) > 1""")
def agg09_time_domain_hrv(spark: SparkSession, sf: str) -> DataFrame:
    """SDNN, SDANN (sections of 18 s), RMSSD, SDSD, NNx and pNNx of every recording."""
    d = _rr(spark, sf).withColumn("dd", F.col("rr") - F.lag("rr").over(W.by("t_ms", "peak_id")))
    ev = events(spark, sf)
    sn = ev.groupBy(REC).agg(F.greatest(F.lit(1), F.floor(F.max("t_ms") / 18000 + 0.5)).alias("sections"))
    sec = ev.withColumn("s", F.expr("t_ms div 18000")).join(sn, REC).where("s < sections").groupBy(REC, "s").agg(F.count("*").alias("n"), (F.max("t_ms") - F.min("t_ms")).alias("span")).where("n > 1")
    sdann = sec.groupBy(REC).agg(F.stddev_pop(F.col("span") / (F.col("n") - 1)).alias("sdann"))
    over = lambda x: F.count_if(F.abs("dd") > x)
    n = F.count("*")
    out = d.groupBy(REC).agg(n.alias("n"), F.round(F.stddev_pop("rr"), 5).alias("sdnn"), F.round(F.sqrt(F.avg(F.col("dd") * F.col("dd"))), 5).alias("rmssd"), F.round(F.stddev_pop("dd"), 5).alias("sdsd"), over(50).alias("nn50"), F.round(over(50) / (n - 1), 6).alias("pnn50"), over(20).alias("nn20"), F.round(over(20) / (n - 1), 6).alias("pnn20"), F.round(F.stddev_pop("rr") / F.avg("rr"), 6).alias("cv"))
    return out.where("n > 1").join(sdann, REC, "left").select(REC, "sdnn", F.round("sdann", 5).alias("sdann"), "rmssd", "sdsd", "nn50", "pnn50", "nn20", "pnn20", "cv")


@query(f"""{WHR} SELECT rec_id, count(*) AS n_windows, count(*) FILTER (n_peaks > 0) AS worn, count(*) FILTER (n_peaks >= 6) AS good, 5 * count(*) FILTER (n_peaks >= 6) AS good_s, round(100.0 * count(*) FILTER (n_peaks >= 6) / nullif(count(*) FILTER (n_peaks > 0), 0), 4) AS yield_worn, round(100.0 * count(*) FILTER (n_peaks >= 6) / count(*), 4) AS yield_total FROM whr GROUP BY rec_id""")
def agg10_yield(spark: SparkSession, sf: str) -> DataFrame:
    """Windows and seconds that were worn, and that were good."""
    n, worn, good = F.count("*"), F.count_if(F.col("n_peaks") > 0), F.count_if(F.col("n_peaks") >= 6)
    return windowed_hr(events(spark, sf)).groupBy(REC).agg(n.alias("n_windows"), worn.alias("worn"), good.alias("good"), (5 * good).alias("good_s"), F.round(F.try_divide(100 * good, worn), 4).alias("yield_worn"), F.round(100 * good / n, 4).alias("yield_total"))


CNT = f"""{T}, c AS (SELECT rec_id, event_type AS detector, count(*) FILTER (value > 250) AS tp, count(*) FILTER (value <= 250) AS fn FROM ev GROUP BY ALL)"""


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    """A wide table of counts by subject, as benchmark files hold them, taken apart again."""
    wide = events(spark, sf).groupBy(REC).pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.count_if(F.col("value") > 250).alias("TP"), F.count_if(F.col("value") <= 250).alias("FN"))
    cells = wide.unpivot([REC], [c for c in wide.columns if c != REC], "cell", "n").na.fill(0)
    return cells.groupBy(REC, F.substring_index("cell", "_", 1).alias("detector")).agg(F.sum(F.when(F.col("cell").endswith("_TP"), F.col("n"))).alias("tp"), F.sum(F.when(F.col("cell").endswith("_FN"), F.col("n"))).alias("fn"))


@query(f"{CNT} SELECT detector, count(*) AS n, round(avg(100.0 * tp / (tp + fn)), 5) AS mean, round(stddev_pop(100.0 * tp / (tp + fn)), 5) AS std FROM c GROUP BY detector")
def agg12_src16_sensitivity_by_detector(spark: SparkSession, sf: str) -> DataFrame:
    """Mean sensitivity over the subjects that have any true beat."""
    s = 100.0 * F.col("tp") / (F.col("tp") + F.col("fn"))
    return _scores(spark, sf).where("tp + fn > 0").groupBy("detector").agg(F.count("*").alias("n"), F.round(F.avg(s), 5).alias("mean"), F.round(F.stddev_pop(s), 5).alias("std"))


@query(f"""{CNT}, s AS (SELECT rec_id, detector, 100.0 * tp / (tp + fn) AS s FROM c), d AS (SELECT a.detector AS a, b.detector AS b, round(a.s - b.s, 9) AS d FROM s a JOIN s b ON a.rec_id = b.rec_id AND a.detector < b.detector WHERE round(a.s - b.s, 9) <> 0),
r AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a, b, abs(d)) - 1) / 2.0 AS r FROM d), w AS (SELECT a, b, count(*) AS n, sum(r) FILTER (d > 0) AS wp, sum(r) AS wt FROM r GROUP BY ALL)
SELECT a, b, n, round(least(coalesce(wp, 0), wt - coalesce(wp, 0)), 4) AS w, round((least(coalesce(wp, 0), wt - coalesce(wp, 0)) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0), 6) AS z FROM w WHERE n >= 20""")
def agg13_wilcoxon(spark: SparkSession, sf: str) -> DataFrame:
    """Signed-rank statistic and normal score for every pair of detectors with at least 20 differences."""
    s = _scores(spark, sf).where("tp + fn > 0").select(REC, "detector", (100.0 * F.col("tp") / (F.col("tp") + F.col("fn"))).alias("s"))
    d = s.select(REC, F.col("detector").alias("a"), F.col("s").alias("sa")).join(s.select(REC, F.col("detector").alias("b"), F.col("s").alias("sb")), REC).where("a < b")
    d = d.select("a", "b", F.round(F.col("sa") - F.col("sb"), 9).alias("d")).where("d <> 0")
    # ranks from the counts of equal differences, so that no window holds single rows
    c = d.groupBy("a", "b", F.abs("d").alias("m")).agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("np"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("a", "b").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = c.withColumn("r", before + (F.col("n") + 1) / 2)
    w = c.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum(F.col("r") * F.col("np")).alias("wp"), F.sum(F.col("r") * F.col("n")).alias("wt")).where("n >= 20")
    least, n = F.least(F.col("wp"), F.col("wt") - F.col("wp")), F.col("n")
    return w.select("a", "b", "n", F.round(least, 4).alias("w"), F.round((least - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24), 6).alias("z"))


@query(f"""WITH {SM}, p AS (SELECT rec_id, idx AS p FROM sm WHERE idx % 50 = 49), o AS (SELECT p.rec_id, p, arg_max(idx, {{'v': v, 'i': -idx}}) AS at_ FROM p JOIN sm ON sm.rec_id = p.rec_id AND idx >= p - 30 AND idx < p GROUP BY ALL) SELECT rec_id, trunc(quantile_cont(p - at_, 0.5))::BIGINT AS delay FROM o GROUP BY rec_id""")
def agg14_flt10_median_delay(spark: SparkSession, sf: str) -> DataFrame:
    """How long after the largest sample of the 30 before it each detection comes, as a truncated median."""
    s = samples(spark, sf).withColumn("m", F.max(F.struct("v", (-F.col("idx")).alias("i"))).over(W.by("idx").rowsBetween(-30, -1)))
    return s.where("idx % 50 = 49").groupBy(REC).agg(F.percentile(F.col("idx") + F.col("m.i"), 0.5).cast("long").alias("delay"))


@query(f"""{"WITH " + FR}, k AS (SELECT label, rec_id % 3 AS pipeline, list_max(x) AS top FROM fr) SELECT label, round(avg(top) FILTER (pipeline = 0), 6) AS p0, round(avg(top) FILTER (pipeline = 1), 6) AS p1, round(avg(top) FILTER (pipeline = 2), 6) AS p2, round(avg(top), 6) AS mean FROM k GROUP BY label""")
def agg15_agg21_pivot_mean_by_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """A column for each pipeline, and the mean over them."""
    from .bindings import frames

    k = frames(spark, sf).select("label", F.expr("rec_id % 3").alias("pipeline"), F.array_max("x").alias("top"))
    wide = k.groupBy("label").pivot("pipeline", [0, 1, 2]).agg(F.round(F.avg("top"), 6)).withColumnsRenamed({"0": "p0", "1": "p1", "2": "p2"})
    return wide.join(k.groupBy("label").agg(F.round(F.avg("top"), 6).alias("mean")), "label")


@query(f"""{T}, l AS (SELECT doc_id % 150 AS rec_id, avg(quality) AS sqi FROM labels GROUP BY ALL) SELECT CASE WHEN sqi < 0.9 THEN 'low' ELSE 'high' END AS band, count(*) AS n, round(avg(value), 5) AS mean FROM ev JOIN l ON ev.rec_id % 150 = l.rec_id GROUP BY ALL""")
def agg16_means_by_quality_band(spark: SparkSession, sf: str) -> DataFrame:
    """Mean value of beats in recordings of low and of high quality."""
    l = spark.read.parquet(f"{sf}/labels.parquet").groupBy(F.expr("doc_id % 150").alias("r")).agg(F.avg("quality").alias("sqi"))
    j = events(spark, sf).join(l, F.expr("rec_id % 150 = r"))
    return j.groupBy(F.when(F.col("sqi") < 0.9, "low").otherwise("high").alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 5).alias("mean"))


@query(f"{T}, n AS (SELECT rec_id, count(*) AS n FROM ev GROUP BY rec_id) SELECT n // 10 AS bin, count(*) AS records, sum(n)::BIGINT AS beats FROM n GROUP BY ALL")
def agg17_agg22_beat_count_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Recordings by their number of beats in tens, and all their beats."""
    n = events(spark, sf).groupBy(REC).agg(F.count("*").alias("n"))
    return n.groupBy(F.expr("n div 10").alias("bin")).agg(F.count("*").alias("records"), F.sum("n").alias("beats"))


@query(f"""{T} SELECT rec_id, round((max(t_ms) - min(t_ms)) / 3600000.0, 9) AS hours, round((max(t_ms) - min(t_ms)) / 3600000.0 / (count(*) * 0.001), 6) AS hours_per_s FROM ev GROUP BY rec_id""")
def agg20_throughput(spark: SparkSession, sf: str) -> DataFrame:
    """Hours of signal for each second of computing."""
    hours = (F.max("t_ms") - F.min("t_ms")) / 3600000
    return events(spark, sf).groupBy(REC).agg(F.round(hours, 9).alias("hours"), F.round(hours / (F.count("*") * 0.001), 6).alias("hours_per_s"))


EVAL = f"""{CNT}, f AS (SELECT detector, sum(tp)::BIGINT AS tp, sum(fn)::BIGINT AS fn, round(2.0 * sum(tp) / (2.0 * sum(tp) + sum(fn)), 6) AS f1 FROM c GROUP BY detector)"""


def _eval(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).groupBy("detector").agg(F.sum("tp").alias("tp"), F.sum("fn").alias("fn")).withColumn("f1", F.round(2.0 * F.col("tp") / (2.0 * F.col("tp") + F.col("fn")), 6))


@query(f"{EVAL} SELECT detector, tp, fn, f1, row_number() OVER (ORDER BY f1 DESC, detector)::INTEGER AS place FROM f")
def top01_ranked_by_f1(spark: SparkSession, sf: str) -> DataFrame:
    """Detectors in order of F1; there is one row for each detector, so one task can number them."""
    return _eval(spark, sf).withColumn("place", F.row_number().over(Window.orderBy(F.desc("f1"), "detector")))


@query(f"{EVAL} SELECT detector, f1 FROM f WHERE detector <> 'error' ORDER BY f1 DESC, detector LIMIT 3")
def top02_top_n_without_one(spark: SparkSession, sf: str) -> DataFrame:
    """The three best detectors but for one."""
    return _eval(spark, sf).where("detector <> 'error'").select("detector", "f1").orderBy(F.desc("f1"), "detector").limit(3)


@query(f"{T} SELECT rec_id, count(*) AS n FROM ev GROUP BY rec_id ORDER BY n DESC, rec_id LIMIT 3")
def top03_most_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """The three recordings with the most peaks."""
    return events(spark, sf).groupBy(REC).agg(F.count("*").alias("n")).orderBy(F.desc("n"), REC).limit(3)


@query(f"{T}, r AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY t_ms, peak_id) AS k FROM ev) SELECT rec_id, peak_id, k::INTEGER AS k FROM r WHERE k <= 5")
def top04_first_beats(spark: SparkSession, sf: str) -> DataFrame:
    """The first five beats of each recording."""
    return events(spark, sf).withColumn("k", F.row_number().over(W.by("t_ms", "peak_id"))).where("k <= 5").select(REC, "peak_id", "k")


@query(f"WITH {SM} SELECT rec_id, arg_max(idx, {{'v': v, 'i': -idx}}) AS at_max, arg_min(idx, {{'v': v, 'i': idx}}) AS at_min FROM sm GROUP BY rec_id")
def top05_argmax_argmin(spark: SparkSession, sf: str) -> DataFrame:
    """Places of the largest and the least sample, of equal ones the first."""
    i = F.col("idx")
    return samples(spark, sf).groupBy(REC).agg(F.max_by("idx", F.struct("v", (-i).alias("i"))).alias("at_max"), F.min_by("idx", F.struct("v", i.alias("i"))).alias("at_min"))


@query(f"{T} SELECT rec_id, t_ms FROM ev WHERE event_type = 'view' UNION SELECT rec_id, t_ms FROM ev WHERE event_type = 'click'")
def set01_union_of_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """Peaks that either of two detectors found, once each."""
    return peaks(spark, sf, "view").select(REC, "t_ms").union(peaks(spark, sf, "click").select(REC, "t_ms")).distinct()


@query(f"{EVAL} SELECT detector, 'Individual' AS kind, f1 FROM f UNION ALL SELECT 'consensus', 'Consensus', round(avg(f1), 5) FROM f")
def set04_append_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every detector's score, and a row for the consensus of all."""
    e = _eval(spark, sf)
    return e.select("detector", F.lit("Individual").alias("kind"), "f1").unionByName(e.agg(F.round(F.avg("f1"), 5).alias("f1")).select(F.lit("consensus").alias("detector"), F.lit("Consensus").alias("kind"), "f1"))


@query(f"{T} SELECT rec_id, t_ms, value FROM ev")
def set03_chunk_concat(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of a table, read one by one, as one table again; Spark runs them as one scan of each."""
    kinds = ("view", "signup", "error", "click", "purchase")
    chunks = [peaks(spark, sf, k).select(REC, "t_ms", "value") for k in kinds]
    return reduce(DataFrame.unionByName, chunks)


#: Fixed value: the first row of the test part.
SPLIT = 1936


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey < {SPLIT} THEN 'train' ELSE 'test' END AS part FROM lineitem")
def set05_split_by_row(spark: SparkSession, sf: str) -> DataFrame:
    """Rows numbered below SPLIT are for training, the rest for testing; here an order is a row of the signal table."""
    part = F.when(F.col("l_orderkey") < SPLIT, "train").otherwise("test")
    return spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", part.alias("part"))
