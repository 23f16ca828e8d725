"""JOI: as-of, nearest, interval and scoring joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import joins as J
from .bindings import EV, FS, events, frame_samples, peaks
from .registry import query

REC = "rec_id"
#: Per kind of event a table of peaks.
T = f"WITH {EV}, vw AS (SELECT * FROM ev WHERE event_type = 'view'), ck AS (SELECT * FROM ev WHERE event_type = 'click'), su AS (SELECT * FROM ev WHERE event_type = 'signup'), pu AS (SELECT * FROM ev WHERE event_type = 'purchase'), er AS (SELECT * FROM ev WHERE event_type = 'error')"


@query(f"""{T}, hit AS (SELECT s.rec_id, s.peak_id AS label_id, s.t_ms AS label_ms, arg_min({{'t': v.t_ms, 'p': v.peak_id}}, {{'t': v.t_ms, 'p': v.peak_id}}) AS m
  FROM su s JOIN vw v ON v.rec_id = s.rec_id AND v.t_ms BETWEEN s.t_ms AND s.t_ms + 1000 GROUP BY ALL),
r AS (SELECT rec_id, m.p AS peak_id, m.t AS t_ms, label_id, label_ms, row_number() OVER (PARTITION BY m.p ORDER BY label_ms DESC, label_id DESC) AS k FROM hit)
SELECT rec_id, peak_id, t_ms, label_id, label_ms, t_ms - label_ms AS diff_ms FROM r WHERE k = 1""")
def joi01_asof_forward_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    """Labels go to the first sample at or after them within a second; of labels on one sample the last wins."""
    labels = peaks(spark, sf, "signup").select(REC, F.col("peak_id").alias("label_id"), F.col("t_ms").alias("label_ms"))
    hit = _forward(spark, sf, labels)
    last = Window.partitionBy("peak_id").orderBy(F.desc("label_ms"), F.desc("label_id"))
    return hit.withColumn("k", F.row_number().over(last)).where("k = 1").select(REC, "peak_id", "t_ms", "label_id", "label_ms", (F.col("t_ms") - F.col("label_ms")).alias("diff_ms"))


def _forward(spark: SparkSession, sf: str, labels: DataFrame) -> DataFrame:
    near = J.first_after(labels.select(REC, F.col("label_id").alias("peak_id"), F.col("label_ms").alias("t_ms")), peaks(spark, sf, "view"), {"peak_id": "to_id", "t_ms": "to_ms"})
    return near.where("to_ms - t_ms <= 1000").select(REC, F.col("to_id").alias("peak_id"), F.col("to_ms").alias("t_ms"), F.col("peak_id").alias("label_id"), F.col("t_ms").alias("label_ms"))


NEAREST_LATE = """arg_min({'t': v.t_ms, 'p': v.peak_id}, {'d': abs(v.t_ms - s.t_ms), 't': -v.t_ms, 'p': v.peak_id})"""


@query(f"""{T}, hit AS (SELECT s.rec_id, s.peak_id AS label_id, s.t_ms AS label_ms, {NEAREST_LATE} AS m FROM su s JOIN vw v USING (rec_id) GROUP BY ALL)
SELECT rec_id, m.p AS peak_id, m.t AS t_ms, string_agg(label_id::VARCHAR, '; ' ORDER BY label_ms, label_id) AS labels, count(*) AS n_labels FROM hit GROUP BY ALL""")
def joi02_nearest_merge_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Every label goes to the nearest sample, the later one of two equally near; labels on one sample are joined."""
    labels, rows = peaks(spark, sf, "signup"), peaks(spark, sf, "view")
    first = rows.groupBy(REC, "t_ms").agg(F.min("peak_id").alias("peak_id"))
    both = J.first_after(J.last_before(labels, first, {"peak_id": "b_id", "t_ms": "b_ms"}), first, {"peak_id": "a_id", "t_ms": "a_ms"})
    back = F.col("b_ms").isNotNull() & (F.col("a_ms").isNull() | (F.col("t_ms") - F.col("b_ms") < F.col("a_ms") - F.col("t_ms")))
    hit = both.where("b_ms is not null or a_ms is not null").select(REC, F.when(back, F.col("b_id")).otherwise(F.col("a_id")).alias("to_id"), F.when(back, F.col("b_ms")).otherwise(F.col("a_ms")).alias("to_ms"), "peak_id", "t_ms")
    own = F.sort_array(F.collect_list(F.struct("t_ms", "peak_id")))
    got = hit.groupBy(REC, F.col("to_id").alias("peak_id_"), F.col("to_ms").alias("t_ms_")).agg(own.alias("own"))
    return got.select(REC, F.col("peak_id_").alias("peak_id"), F.col("t_ms_").alias("t_ms"), F.array_join(F.transform("own", lambda x: x["peak_id"].cast("string")), "; ").alias("labels"), F.size("own").cast("long").alias("n_labels"))


@query(f"""{T}, g AS (SELECT rec_id, unnest(range(min(t_ms), max(t_ms) + 1, 250)) AS t_ms FROM vw GROUP BY rec_id),
hit AS (SELECT s.rec_id, s.peak_id AS label_id, arg_min(g.t_ms, {{'d': abs(g.t_ms - s.t_ms), 't': -g.t_ms}}) AS grid_ms FROM su s JOIN g USING (rec_id) GROUP BY ALL)
SELECT rec_id, grid_ms, count(*) AS n_labels, min(label_id) AS first_label FROM hit GROUP BY ALL""")
def joi03_nearest_on_resampled_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Labels on a regular grid: the nearest point is arithmetic, no join with the grid's points is needed."""
    span = peaks(spark, sf, "view").groupBy(REC).agg(F.min("t_ms").alias("lo"), F.max("t_ms").alias("hi"))
    last = F.expr("(hi - lo) div 250")
    k = F.least(last, F.greatest(F.lit(0), F.floor((F.col("t_ms") - F.col("lo")) / 250 + 0.5))).cast("long")
    return peaks(spark, sf, "signup").join(span, REC).withColumn("grid_ms", F.col("lo") + k * 250).groupBy(REC, "grid_ms").agg(F.count("*").alias("n_labels"), F.min("peak_id").alias("first_label"))


@query(f"""{T}, n AS (SELECT s.rec_id, s.peak_id, s.t_ms, arg_min(v.peak_id, {{'t': v.t_ms, 'p': v.peak_id}}) FILTER (v.t_ms >= s.t_ms) AS nx, arg_max(v.peak_id, {{'t': v.t_ms, 'p': v.peak_id}}) AS ls
  FROM pu s LEFT JOIN vw v USING (rec_id) GROUP BY ALL)
SELECT rec_id, peak_id, t_ms, coalesce(nx, ls) AS beat_id, CASE WHEN nx IS NOT NULL THEN 'Next Beat (Forward)' WHEN ls IS NOT NULL THEN 'Last Beat (Fallback)' ELSE 'No Beats' END AS note FROM n""")
def joi04_forward_else_last(spark: SparkSession, sf: str) -> DataFrame:
    """The next beat at or after each mark, or else the last one."""
    beats = peaks(spark, sf, "view")
    nx = J.first_after(peaks(spark, sf, "purchase").select(REC, "peak_id", "t_ms"), beats, {"peak_id": "nx"})
    last = beats.groupBy(REC).agg(F.max_by("peak_id", F.struct("t_ms", "peak_id")).alias("ls"))
    note = F.when(F.col("nx").isNotNull(), "Next Beat (Forward)").when(F.col("ls").isNotNull(), "Last Beat (Fallback)").otherwise("No Beats")
    return nx.join(last, REC, "left").select(REC, "peak_id", "t_ms", F.coalesce("nx", "ls").alias("beat_id"), note.alias("note"))


@query(f"""{T}, n AS (SELECT v.rec_id, v.peak_id, v.t_ms, max(p.t_ms) FILTER (p.t_ms <= v.t_ms) AS d, min(p.t_ms) AS f FROM vw v JOIN pu p USING (rec_id) GROUP BY ALL)
SELECT rec_id, peak_id, t_ms, coalesce(d, f) AS dose_ms, round((t_ms - coalesce(d, f)) / 1000.0, 3) AS since_s FROM n""")
def joi05_asof_latest_dose(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds since the latest dose; before the first one, negative seconds to it."""
    doses = peaks(spark, sf, "purchase")
    first = doses.groupBy(REC).agg(F.min("t_ms").alias("f"))
    got = J.last_before(peaks(spark, sf, "view").select(REC, "peak_id", "t_ms"), doses, {"t_ms": "d"}).join(first, REC)
    dose = F.coalesce("d", "f")
    return got.select(REC, "peak_id", "t_ms", dose.alias("dose_ms"), F.round((F.col("t_ms") - dose) / 1000, 3).alias("since_s"))


@query(f"""{T} SELECT rec_id, peak_id, t_ms FROM vw v WHERE EXISTS (SELECT 1 FROM er e WHERE e.rec_id = v.rec_id AND v.t_ms >= e.t_ms AND v.t_ms < e.t_ms + 2000)""")
def joi06_interval_membership(spark: SparkSession, sf: str) -> DataFrame:
    """Beats inside any window [start, start + 2 s): the windows that can hold a beat begin within 2 s before it."""
    starts = peaks(spark, sf, "error").select(REC, F.col("t_ms").alias("s_ms"))
    beats = peaks(spark, sf, "view").select(REC, "peak_id", "t_ms")
    got = J.last_before(beats, starts.withColumn("peak_id", F.col("s_ms")).withColumnRenamed("s_ms", "t_ms"), {"t_ms": "s_ms"})
    return got.where("t_ms - s_ms < 2000").select(REC, "peak_id", "t_ms")


@query(f"""{T}, n AS (SELECT v.rec_id, v.peak_id, v.t_ms, count(e.peak_id) AS any_, arg_min(e.peak_id, {{'t': e.t_ms, 'p': e.peak_id}}) FILTER (v.t_ms BETWEEN e.t_ms AND e.t_ms + 3000) AS w FROM vw v LEFT JOIN er e USING (rec_id) GROUP BY ALL)
SELECT rec_id, peak_id, w AS window_id, CASE WHEN any_ = 0 THEN 'Unknown' WHEN w IS NULL THEN 'Out of Range' ELSE 'In Window' END AS status FROM n""")
def joi07_point_in_interval_first(spark: SparkSession, sf: str) -> DataFrame:
    """The first window, closed at both ends, that holds each beat: the first one to start within 3 s before it."""
    beats = peaks(spark, sf, "view").select(REC, "peak_id", "t_ms", (F.col("t_ms") - 3000).alias("from_ms"))
    marks = peaks(spark, sf, "error").select(REC, F.col("peak_id").alias("window_id"), F.col("t_ms").alias("s_ms"))
    first = J.first_after(beats.select(REC, "peak_id", F.col("from_ms").alias("t_ms")), marks.select(REC, "window_id", F.col("s_ms").alias("t_ms"), F.col("window_id").alias("peak_id")), {"window_id": "window_id", "t_ms": "s_ms"})
    some = marks.select(REC).distinct().withColumn("any_", F.lit(True))
    fits = F.col("s_ms") <= F.col("t_ms") + 3000
    status = F.when(F.col("any_").isNull(), "Unknown").when(fits, "In Window").otherwise("Out of Range")
    return first.join(some, REC, "left").select(REC, "peak_id", F.when(fits, F.col("window_id")).alias("window_id"), status.alias("status"))


MATCH = """nr AS (SELECT t.rec_id, t.peak_id, arg_min({'p': r.peak_id, 't': r.t_ms}, {'d': abs(r.t_ms - t.t_ms), 't': r.t_ms, 'p': r.peak_id}) AS m, any_value(t.t_ms) AS t_ms FROM vw t JOIN ck r USING (rec_id) GROUP BY t.rec_id, t.peak_id),
tp AS (SELECT rec_id, count(DISTINCT m.p) AS tp FROM nr WHERE abs(m.t - t_ms) <= 50 GROUP BY rec_id),
cn AS (SELECT rec_id, count(*) FILTER (event_type = 'click') AS n_ref, count(*) FILTER (event_type = 'view') AS n_test FROM ev WHERE event_type IN ('click', 'view') GROUP BY rec_id),
bc AS (SELECT rec_id, n_ref, n_test, coalesce(tp, 0) AS tp, n_test - coalesce(tp, 0) AS fp, n_ref - coalesce(tp, 0) AS fn FROM cn LEFT JOIN tp USING (rec_id))"""


def _matches(spark: SparkSession, sf: str) -> DataFrame:
    return J.beat_counts(peaks(spark, sf, "view").select(REC, "peak_id", "t_ms"), peaks(spark, sf, "click").select(REC, "peak_id", "t_ms"), 50)


@query(f"{T}, {MATCH} SELECT * FROM bc")
def joi08_beat_match_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Reference and test beats, and test beats nearest to a reference within the tolerance, one to one."""
    return _matches(spark, sf)


@query(f"""{T}, {MATCH}, r AS (SELECT *, tp / (tp + fn + 1e-9) AS s, tp / (tp + fp + 1e-9) AS p FROM bc)
SELECT rec_id, tp, fp, fn, round(s, 4) AS se, round(p, 4) AS ppv, round(2 * s * p / (s + p + 1e-9), 4) AS f1 FROM r""")
def agg03_se_ppv_f1(spark: SparkSession, sf: str) -> DataFrame:
    """Sensitivity, precision and F1 of the matches."""
    return _matches(spark, sf).select(REC, "tp", "fp", "fn", *J.rates(F.col("tp"), F.col("fp"), F.col("fn")))


@query(f"""{T}, o AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY t_ms, peak_id) AS k FROM vw),
loc AS (SELECT p.rec_id, p.peak_id, p.t_ms, q.peak_id AS q_id, q.t_ms AS q_ms FROM o p JOIN o q ON q.rec_id = p.rec_id AND q.k BETWEEN p.k - 5 AND p.k + 5),
dd AS (SELECT l.rec_id, l.peak_id, l.t_ms, l.q_id, arg_min(r.t_ms - l.q_ms, {{'d': abs(r.t_ms - l.q_ms), 't': r.t_ms}}) AS d FROM loc l JOIN ck r ON r.rec_id = l.rec_id AND r.t_ms BETWEEN l.t_ms - 2000 AND l.t_ms + 2000 GROUP BY ALL),
de AS (SELECT rec_id, peak_id, quantile_cont(d, 0.5) AS d FROM dd WHERE abs(d) < 450 GROUP BY ALL),
al AS (SELECT o.rec_id, o.peak_id, o.t_ms + coalesce(d, 0) AS t_ms FROM o LEFT JOIN de USING (rec_id, peak_id)),
nr AS (SELECT a.rec_id, a.peak_id, any_value(a.t_ms) AS t_ms, arg_min({{'p': r.peak_id, 't': r.t_ms}}, {{'d': abs(r.t_ms - a.t_ms), 't': r.t_ms, 'p': r.peak_id}}) AS m FROM al a JOIN ck r USING (rec_id) GROUP BY a.rec_id, a.peak_id),
tp AS (SELECT rec_id, count(DISTINCT m.p) AS tp FROM nr WHERE abs(m.t - t_ms) <= 100 GROUP BY rec_id),
cn AS (SELECT rec_id, count(*) FILTER (event_type = 'click') AS n_ref, count(*) FILTER (event_type = 'view') AS n_test FROM ev WHERE event_type IN ('click', 'view') GROUP BY rec_id)
SELECT rec_id, n_ref, n_test, coalesce(tp, 0) AS tp, n_test - coalesce(tp, 0) AS fp, n_ref - coalesce(tp, 0) AS fn FROM cn LEFT JOIN tp USING (rec_id)""")
def joi09_time_warped_match(spark: SparkSession, sf: str) -> DataFrame:
    """Beats matched after each is moved by the median delay of its eleven neighbours to the refs around it.

    A neighbour's nearest ref is looked for only among the refs within 2 s of the beat, hence the range join.
    """
    test, refs = peaks(spark, sf, "view").select(REC, "peak_id", "t_ms"), peaks(spark, sf, "click").select(REC, "peak_id", "t_ms")
    near = Window.partitionBy(REC).orderBy("t_ms", "peak_id").rowsBetween(-5, 5)
    local = test.withColumn("own", F.collect_list(F.struct("peak_id", "t_ms")).over(near)).withColumn("lo", F.col("t_ms") - 2000).withColumn("hi", F.col("t_ms") + 2000)
    around = J.band_join(local, refs.select(REC, F.col("t_ms").alias("ref_ms")), "lo", "hi", "ref_ms", 4000).groupBy(REC, "peak_id").agg(F.first("own").alias("own"), F.collect_list("ref_ms").alias("refs"))
    gap = F.transform("own", lambda q: F.array_min(F.transform("refs", lambda r: F.struct(F.abs(r - q["t_ms"]).alias("d"), r.alias("r"), (r - q["t_ms"]).alias("gap"))))["gap"])
    delay = around.select(REC, "peak_id", F.explode(gap).alias("d")).where("abs(d) < 450").groupBy(REC, "peak_id").agg(F.percentile("d", 0.5).alias("d"))
    aligned = test.join(delay, [REC, "peak_id"], "left").select(REC, "peak_id", (F.col("t_ms") + F.coalesce("d", F.lit(0.0))).alias("t_ms"))
    return J.beat_counts(aligned, refs.withColumn("t_ms", F.col("t_ms").cast("double")), 100)


@query(f"""{T}, t AS (SELECT DISTINCT rec_id, t_ms FROM vw), r AS (SELECT DISTINCT rec_id, t_ms FROM ck),
h AS (SELECT rec_id, count(*) AS tp FROM t WHERE EXISTS (SELECT 1 FROM r WHERE r.rec_id = t.rec_id AND r.t_ms BETWEEN t.t_ms - 30 - 100 AND t.t_ms - 30 + 100) GROUP BY rec_id),
a AS (SELECT rec_id, count(*) AS n_test FROM t GROUP BY rec_id), b AS (SELECT rec_id, count(*) AS n_ref FROM r GROUP BY rec_id)
SELECT rec_id, coalesce(tp, 0) AS tp, n_test - coalesce(tp, 0) AS fp, n_ref - coalesce(tp, 0) AS fn FROM a JOIN b USING (rec_id) LEFT JOIN h USING (rec_id)""")
def joi10_membership_with_delay(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct test peaks with any ref in [t - delay - tol, t - delay + tol]; not one to one, so fn may be negative."""
    t = peaks(spark, sf, "view").select(REC, "t_ms").distinct()
    r = peaks(spark, sf, "click").select(REC, "t_ms").distinct()
    hit = J.nearest(t.withColumn("t_ms", F.col("t_ms") - 30).withColumn("peak_id", F.col("t_ms")), r.withColumn("peak_id", F.col("t_ms")), {"t_ms": "ref_ms"}).where("abs(t_ms - ref_ms) <= 100").groupBy(REC).agg(F.count("*").alias("tp"))
    n = t.groupBy(REC).agg(F.count("*").alias("n_test")).join(r.groupBy(REC).agg(F.count("*").alias("n_ref")), REC).join(hit, REC, "left")
    tp = F.coalesce("tp", F.lit(0))
    return n.select(REC, tp.alias("tp"), (F.col("n_test") - tp).alias("fp"), (F.col("n_ref") - tp).alias("fn"))


CPSC = """r AS (SELECT rec_id, peak_id, t_ms AS r, row_number() OVER w AS j, count(*) OVER (PARTITION BY rec_id) AS n, lead(t_ms) OVER w AS nx FROM ck WINDOW w AS (PARTITION BY rec_id ORDER BY t_ms, peak_id)),
b AS (SELECT *, CASE WHEN j = 1 THEN 575 ELSE r + 75 END AS lo, CASE WHEN j = 1 THEN r - 75 WHEN j = n THEN 71425 ELSE nx - 75 END AS hi FROM r),
s AS (SELECT b.rec_id, b.peak_id, count(v.peak_id) FILTER (abs(v.t_ms - b.r) <= 75) AS loc, count(v.peak_id) FILTER (v.t_ms >= b.lo AND v.t_ms <= b.hi) AS err FROM b LEFT JOIN vw v USING (rec_id) GROUP BY ALL),
sc AS (SELECT rec_id, count(*) FILTER (loc > 0) AS tp, count(*) FILTER (loc = 0) AS fn, sum(err + greatest(loc - 1, 0))::BIGINT AS fp FROM s GROUP BY rec_id)"""


def _cpsc(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of answers by running totals: answers in [a, b] = answers up to b less answers before a."""
    ans = peaks(spark, sf, "view").select(REC, "peak_id", "t_ms")
    w = Window.partitionBy(REC).orderBy("t_ms", "peak_id")
    refs = peaks(spark, sf, "click").select(REC, "peak_id", "t_ms").withColumn("j", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(REC))).withColumn("nx", F.lead("t_ms").over(w))
    refs = refs.withColumn("lo", F.when(F.col("j") == 1, F.lit(575)).otherwise(F.col("t_ms") + 75)).withColumn("hi", F.when(F.col("j") == 1, F.col("t_ms") - 75).when(F.col("j") == F.col("n"), F.lit(71425)).otherwise(F.col("nx") - 75))
    upto = ans.withColumn("k", F.row_number().over(w))
    upto = upto.groupBy(REC, "t_ms").agg(F.max("k").alias("k")).withColumn("peak_id", F.col("t_ms"))
    probe = refs.select(REC, "peak_id", F.explode(F.array(*[F.struct(F.lit(n).alias("e"), c.cast("long").alias("t")) for n, c in (("la", F.col("t_ms") - 76), ("lb", F.col("t_ms") + 75), ("ea", F.col("lo") - 1), ("eb", F.col("hi")))])).alias("p"))
    got = J.last_before(probe.select(REC, "peak_id", F.col("p.e").alias("e"), F.col("p.t").alias("t_ms")), upto, {"k": "k"}).groupBy(REC, "peak_id").pivot("e", ["la", "lb", "ea", "eb"]).agg(F.coalesce(F.first("k"), F.lit(0)))
    zero = got.na.fill(0)
    loc, err = F.col("lb") - F.col("la"), F.greatest(F.lit(0), F.col("eb") - F.col("ea"))
    per = zero.select(REC, loc.alias("loc"), err.alias("err"))
    return per.groupBy(REC).agg(F.count_if(F.col("loc") > 0).alias("tp"), F.count_if(F.col("loc") == 0).alias("fn"), F.sum(F.col("err") + F.greatest(F.col("loc") - 1, F.lit(0))).cast("long").alias("fp"))


@query(f"{T}, {CPSC} SELECT * FROM sc")
def joi11_interval_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """Answers near a ref are hits, more of them and answers between the refs' zones are false."""
    return _cpsc(spark, sf)


@query(f"""{T}, {CPSC}, h AS (SELECT rec_id, avg(value) FILTER (event_type = 'view') AS a, avg(value) FILTER (event_type = 'click') AS r FROM ev GROUP BY rec_id)
SELECT rec_id, tp, fn, fp, CASE WHEN fn + fp > 1 THEN 0.0 WHEN fn = 1 AND fp = 0 THEN 0.3 WHEN fn = 0 AND fp = 1 THEN 0.7 ELSE 1.0 END::DOUBLE AS flag,
 CASE WHEN abs(floor(a) - floor(r)) <= 0.02 * r THEN 1.0 WHEN abs(floor(a) - floor(r)) <= 0.05 * r THEN 0.75 WHEN abs(floor(a) - floor(r)) <= 0.1 * r THEN 0.5 WHEN abs(floor(a) - floor(r)) <= 0.2 * r THEN 0.25 ELSE 0.0 END::DOUBLE AS hr_score
FROM sc JOIN h USING (rec_id) WHERE a IS NOT NULL""")
def agg11_record_score(spark: SparkSession, sf: str) -> DataFrame:
    """Flag of a record by its errors, and tiers of the heart-rate error (here: of the mean values, cut to integers)."""
    # sums of decimals are exact in any order, so that a mean that is a whole number is not cut to the one below; sides with a value
    # that is no decimal of 8 places (too fine, too large or not a number) have means of doubles, as in the SQL
    value = F.col("value")
    exact = value.try_cast("decimal(18,8)")
    other = value.isNotNull() & ~exact.cast("double").eqNullSafe(value)
    of = lambda k, x: F.when(F.col("event_type") == k, x)
    sides = [(f"{n}{side}", f(of(k, x))) for side, k in (("a", "view"), ("r", "click")) for n, f, x in (("s", F.sum, exact), ("n", F.count, value), ("m", F.avg, value), ("o", F.bool_or, other))]
    h = events(spark, sf).groupBy(REC).agg(*[x.alias(n) for n, x in sides]).where("na > 0")
    some = lambda side: F.when(F.col(f"n{side}") > 0, F.col(f"n{side}"))
    whole = lambda side: ((F.col(f"s{side}") - F.pmod(f"s{side}", some(side))) / some(side)).cast("long")
    off, rough = F.abs(whole("a") - whole("r")), F.abs(F.floor("ma") - F.floor("mr"))
    doubles = F.coalesce("oa", F.lit(False)) | F.coalesce("or", F.lit(False))
    tier = F.lit(0.0)
    for share, points in ((20, 0.25), (10, 0.5), (5, 0.75), (2, 1.0)):
        near = F.when(doubles, rough <= share / 100 * F.col("mr")).otherwise(off * 100 * F.col("nr") <= share * F.col("sr"))
        tier = F.when(near, points).otherwise(tier)
    fn, fp = F.col("fn"), F.col("fp")
    flag = F.when(fn + fp > 1, 0.0).when((fn == 1) & (fp == 0), 0.3).when((fn == 0) & (fp == 1), 0.7).otherwise(1.0)
    return _cpsc(spark, sf).join(h, REC).select(REC, "tp", "fn", "fp", flag.alias("flag"), tier.alias("hr_score"))


@query(f"""{T}, a AS (SELECT r.rec_id, r.peak_id, r.t_ms, min(o.t_ms) AS onset FROM vw r JOIN ck o ON o.rec_id = r.rec_id AND o.t_ms BETWEEN r.t_ms + 100 AND r.t_ms + 400 GROUP BY ALL),
b AS (SELECT a.*, min(p.t_ms) AS peak FROM a LEFT JOIN er p ON p.rec_id = a.rec_id AND p.t_ms > a.onset GROUP BY ALL)
SELECT b.rec_id, b.peak_id, b.t_ms, onset, peak, min(o.t_ms) AS next_onset FROM b LEFT JOIN ck o ON o.rec_id = b.rec_id AND o.t_ms > b.peak GROUP BY ALL""")
def joi12_r_peak_onset_peak_chain(spark: SparkSession, sf: str) -> DataFrame:
    """R peak to the first onset 100-400 ms later, then the next pulse peak, then the next onset: as-of joins in a row."""
    onset, pulse = peaks(spark, sf, "click").select(REC, "peak_id", "t_ms"), peaks(spark, sf, "error").select(REC, "peak_id", "t_ms")
    at = lambda d, c: d.withColumn("r_ms", F.col("t_ms")).withColumn("t_ms", c)
    a = J.first_after(at(peaks(spark, sf, "view").select(REC, "peak_id", "t_ms"), F.col("t_ms") + 100), onset, {"t_ms": "onset"})
    a = a.where("onset <= r_ms + 400").withColumn("t_ms", F.col("onset"))
    b = J.first_after(a, pulse, {"t_ms": "peak"}, strict=True)
    some, none = b.where("peak is not null").withColumn("t_ms", F.col("peak")), b.where("peak is null").withColumn("next_onset", F.lit(None).cast("long"))
    c = J.first_after(some, onset, {"t_ms": "next_onset"}, strict=True)
    return c.unionByName(none).select(REC, "peak_id", F.col("r_ms").alias("t_ms"), "onset", "peak", "next_onset")


@query(f"""{T} SELECT o.rec_id, o.peak_id AS onset_id, o.t_ms AS onset_ms, arg_min(p.peak_id, {{'t': p.t_ms, 'p': p.peak_id}}) AS peak_id FROM ck o JOIN vw p ON p.rec_id = o.rec_id AND p.t_ms > o.t_ms GROUP BY ALL""")
def joi13_onset_next_peak(spark: SparkSession, sf: str) -> DataFrame:
    """The first peak after each onset."""
    got = J.first_after(peaks(spark, sf, "click").select(REC, "peak_id", "t_ms"), peaks(spark, sf, "view"), {"peak_id": "next_id"}, strict=True)
    return got.where("next_id is not null").select(REC, F.col("peak_id").alias("onset_id"), F.col("t_ms").alias("onset_ms"), F.col("next_id").alias("peak_id"))


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("k", F.row_number().over(Window.partitionBy(REC).orderBy("t_ms", "peak_id")))


@query(f"""{T}, a AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY t_ms, peak_id) AS k FROM ck), b AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY t_ms, peak_id) AS k FROM vw)
SELECT a.rec_id, a.k::INTEGER AS k, a.t_ms AS ref_ms, b.t_ms AS test_ms, round(b.value - a.value, 6) AS diff FROM a JOIN b USING (rec_id, k)""")
def joi14_positional_zip(spark: SparkSession, sf: str) -> DataFrame:
    """Two lists of beats side by side by their place, as far as the shorter one goes."""
    a = _numbered(peaks(spark, sf, "click")).select(REC, "k", F.col("t_ms").alias("ref_ms"), F.col("value").alias("va"))
    b = _numbered(peaks(spark, sf, "view")).select(REC, "k", F.col("t_ms").alias("test_ms"), F.col("value").alias("vb"))
    return a.join(b, [REC, "k"]).select(REC, "k", "ref_ms", "test_ms", F.round(F.col("vb") - F.col("va"), 6).alias("diff"))


@query(f"""{T}, e AS (SELECT rec_id, max(t_ms) AS hi FROM vw GROUP BY rec_id)
SELECT r.rec_id, r.peak_id AS ref_id, r.t_ms AS ref_ms, arg_min(v.peak_id, {{'d': abs(v.t_ms - r.t_ms), 't': v.t_ms, 'p': v.peak_id}}) AS peak_id FROM ck r JOIN e USING (rec_id) JOIN vw v USING (rec_id) WHERE r.t_ms <= hi GROUP BY ALL""")
def joi15_nearest_sample_within_span(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest sample to each time that lies inside the signal's span."""
    belt = peaks(spark, sf, "view").select(REC, "peak_id", "t_ms")
    end = belt.groupBy(REC).agg(F.max("t_ms").alias("hi"))
    refs = peaks(spark, sf, "click").select(REC, "peak_id", "t_ms").join(end, REC).where("t_ms <= hi")
    return J.nearest(refs, belt, {"peak_id": "to_id"}).select(REC, F.col("peak_id").alias("ref_id"), F.col("t_ms").alias("ref_ms"), F.col("to_id").alias("peak_id"))


@query(f"""{T}, s AS (SELECT rec_id, greatest(min(t_ms) FILTER (event_type = 'click'), min(t_ms) FILTER (event_type = 'view')) AS lo, least(max(t_ms) FILTER (event_type = 'click'), max(t_ms) FILTER (event_type = 'view')) AS hi FROM ev WHERE event_type IN ('click', 'view') GROUP BY rec_id HAVING count(DISTINCT event_type) = 2)
SELECT rec_id, event_type, count(*) AS n, min(t_ms) AS first_ms, max(t_ms) AS last_ms FROM ev JOIN s USING (rec_id) WHERE event_type IN ('click', 'view') AND t_ms BETWEEN lo AND hi GROUP BY ALL""")
def joi16_overlap_clip(spark: SparkSession, sf: str) -> DataFrame:
    """Both series cut to the time that they share."""
    both = events(spark, sf).where("event_type in ('click', 'view')")
    ends = both.groupBy(REC, "event_type").agg(F.min("t_ms").alias("a"), F.max("t_ms").alias("b")).groupBy(REC).agg(F.max("a").alias("lo"), F.min("b").alias("hi"), F.count("*").alias("c")).where("c = 2")
    return both.join(ends, REC).where("t_ms between lo and hi").groupBy(REC, "event_type").agg(F.count("*").alias("n"), F.min("t_ms").alias("first_ms"), F.max("t_ms").alias("last_ms"))


@query(f"""WITH {FS}, p AS (SELECT rec_id, arg_max(idx, {{'v': v, 'i': -idx}}) AS peak_idx FROM fs GROUP BY rec_id)
SELECT rec_id, peak_idx::BIGINT AS peak_idx, round(v, 6) AS v FROM p JOIN fs USING (rec_id) WHERE idx = peak_idx""")
def joi17_sample_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The sample at each peak."""
    s = frame_samples(spark, sf)
    p = s.groupBy(REC).agg(F.max_by("idx", F.struct("v", (-F.col("idx")).alias("i"))).alias("peak_idx"))
    return p.join(s, (p[REC] == s[REC]) & (p["peak_idx"] == s["idx"])).select(p[REC], "peak_idx", F.round("v", 6).alias("v"))


@query(f"""WITH {FS}, p AS (SELECT rec_id, idx AS p FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM fs WINDOW w AS (PARTITION BY rec_id ORDER BY idx)) WHERE v > a AND v > b AND v > 0.15)
SELECT fs.rec_id, idx::BIGINT AS idx, coalesce(min(abs(idx - p)), 64)::BIGINT AS dist FROM fs LEFT JOIN p USING (rec_id) GROUP BY ALL""")
def joi18_aug01_distance_to_peak(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of every sample to the nearest peak of its frame, by the peaks before and after: no cross product."""
    w = Window.partitionBy(REC).orderBy("idx")
    s = frame_samples(spark, sf).withColumn("a", F.lag("v").over(w)).withColumn("b", F.lead("v").over(w))
    s = s.withColumn("p", F.when((F.col("v") > F.col("a")) & (F.col("v") > F.col("b")) & (F.col("v") > 0.15), F.col("idx")))
    before = F.last("p", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("p", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return s.select(REC, "idx", F.coalesce(F.least(F.col("idx") - before, after - F.col("idx")), F.lit(64)).cast("long").alias("dist"))
