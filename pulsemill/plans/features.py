"""CON, FEA and AUG-16: consensus densities, pulse features, training targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import consensus as C, features as P, joins as J, windows as W
from .bindings import EV, FS, events, frame_samples, peaks
from .quality import WSQI, signal_quality
from .registry import query

REC = "rec_id"
SIGMA = 5.0
#: A place is 20 ms; peaks are 300 ms apart.
APART = 15
DENS = """k AS (SELECT unnest(range(-20, 21)) AS k), tot AS (SELECT sum(exp(-k * k / 50.0)) AS tot FROM k), ln AS (SELECT rec_id, max(t_ms // 20) + 1 AS n FROM ev GROUP BY rec_id),
dn AS (SELECT rec_id, CASE WHEN x < n THEN x ELSE 2 * n - 1 - x END AS t, sum(w * exp(-k * k / 50.0)) / any_value(tot) AS d FROM (SELECT rec_id, w, k, n, ((t + k) % (2 * n) + 2 * n) % (2 * n) AS x FROM (SELECT DISTINCT * FROM pk) JOIN ln USING (rec_id), k), tot GROUP BY ALL),
nd AS (SELECT rec_id, t, d / max(d) OVER (PARTITION BY rec_id) AS d FROM dn)"""
PK = f"WITH {EV}, pk AS (SELECT rec_id, event_type AS detector, t_ms // 20 AS t, 1.0 AS w FROM ev)"


def _detections(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(REC, F.col("event_type").alias("detector"), F.expr("t_ms div 20").alias("t"))


def _lengths(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).groupBy(REC).agg(F.expr("max(t_ms) div 20 + 1").alias("n"))


@query(f"{PK}, {DENS} SELECT rec_id, t, round(d, 6) AS density FROM nd")
def con01_sig16_gaussian_density(spark: SparkSession, sf: str) -> DataFrame:
    """Density of all detectors' beats, of equal weight, at every place that one reaches, reflected at a recording's ends."""
    return C.density(_detections(spark, sf), None, SIGMA, lengths=_lengths(spark, sf)).select(REC, "t", F.round("density", 6).alias("density"))


WEIGHTS = """f AS (SELECT event_type AS detector, ((40 * sum(round(value * 100)::BIGINT) + count(*)) // (2 * count(*))) / 1000000.0 AS weight FROM ev WHERE event_type <> 'error' GROUP BY ALL), o AS (SELECT detector, coalesce(weight, 0.5) AS weight FROM (SELECT DISTINCT event_type AS detector FROM ev) LEFT JOIN f USING (detector))"""
#: Peaks of a density in SQL: of each round those that are highest within reach stay, and remove their neighbours.
CONSENSUS = f"""q AS (SELECT rec_id, t, round(d, 9) AS d FROM nd), z AS (SELECT rec_id, t, max(d) AS d FROM (SELECT * FROM q UNION ALL SELECT rec_id, t + s, 0 FROM q JOIN ln USING (rec_id), (VALUES (-1), (1)) v(s) WHERE t + s >= 0 AND t + s < n) GROUP BY ALL),
b AS (SELECT rec_id, t, d, t - 1 = lag(t) OVER w AND lag(d) OVER w = d AS same, t - 1 = lag(t) OVER w AND lag(d) OVER w < d AS up, t + 1 = lead(t) OVER w AND lead(d) OVER w = d AS level, t + 1 = lead(t) OVER w AND lead(d) OVER w < d AS down FROM z WINDOW w AS (PARTITION BY rec_id ORDER BY t)),
m AS (SELECT rec_id, (min(t) + max(t)) // 2 AS t, any_value(d) AS d FROM (SELECT *, sum((NOT coalesce(same, false))::INT) OVER (PARTITION BY rec_id ORDER BY t) AS run FROM b) GROUP BY rec_id, run HAVING coalesce(bool_or(up), false) AND coalesce(bool_or(down), false) AND any_value(d) >= 0.4),
i AS (SELECT *, sum(far) OVER (PARTITION BY rec_id ORDER BY t) AS island FROM (SELECT *, coalesce((t - lag(t) OVER (PARTITION BY rec_id ORDER BY t) >= {APART})::INT, 1) AS far FROM m)),
c AS (SELECT rec_id, island, list({{'d': d, 't': t}} ORDER BY d DESC, t DESC) AS xs FROM i GROUP BY ALL),
h AS (SELECT rec_id, unnest(list_reduce(list_transform(xs, lambda x: [x]), lambda kept, x: CASE WHEN len(list_filter(kept, lambda y: abs(y.t - x[1].t) < {APART})) > 0 THEN kept ELSE list_concat(kept, x) END)) AS x FROM c)
SELECT rec_id, x.t AS t, round(x.d, 6) AS density FROM h"""


@query(f"{PK}, {DENS}, {CONSENSUS}")
def con01_consensus_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """Peaks of the density of all detectors' beats, 300 ms apart."""
    n = _lengths(spark, sf)
    return C.agreed(_detections(spark, sf), None, SIGMA, n, 0.4, APART).select(REC, "t", F.round("density", 6).alias("density"))


@query(f"""WITH {EV}, {WEIGHTS}, pk AS (SELECT rec_id, event_type AS detector, t_ms // 20 AS t, weight / (SELECT sum(weight) + 1e-9 FROM o) AS w FROM ev JOIN o ON o.detector = ev.event_type), {DENS}, {CONSENSUS}""")
def con02_weighted_consensus_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """Peaks, 300 ms apart, of the density weighted by each detector's score; one detector has none and counts one half. Scores
    are means of whole cents, rounded as whole numbers."""
    score = F.expr("(40 * sum(cast(round(value * 100) AS bigint)) + count(*)) div (2 * count(*)) / 1000000")
    f = events(spark, sf).where("event_type <> 'error'").groupBy(F.col("event_type").alias("detector")).agg(score.alias("weight"))
    n = _lengths(spark, sf)
    return C.agreed(_detections(spark, sf), f, SIGMA, n, 0.4, APART).select(REC, "t", F.round("density", 6).alias("density"))


GATE = f"""WITH {EV}, {WSQI}, gt AS (SELECT e.rec_id, e.t_ms, e.event_type, coalesce(bool_or(w.is_usable), false) AS ensemble FROM ev e LEFT JOIN wq w ON w.rec_id = e.rec_id AND e.t_ms >= window_idx * 5000 + 2500 AND e.t_ms < window_idx * 5000 + 7500 GROUP BY e.rec_id, e.peak_id, e.t_ms, e.event_type),
u AS (SELECT DISTINCT rec_id, t_ms FROM gt WHERE event_type = CASE WHEN ensemble THEN 'click' ELSE 'view' END)"""


@query(f"""WITH RECURSIVE {GATE.removeprefix('WITH ')}, o AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY t_ms) AS k FROM u), r AS (SELECT rec_id, k, t_ms, t_ms AS last, true AS keep FROM o WHERE k = 1
 UNION ALL SELECT o.rec_id, o.k, o.t_ms, CASE WHEN o.t_ms - r.last > 200 THEN o.t_ms ELSE r.last END, o.t_ms - r.last > 200 FROM r JOIN o ON o.rec_id = r.rec_id AND o.k = r.k + 1) SELECT rec_id, t_ms FROM r WHERE keep""")
def con03_pk02_det19_gated_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Beats of one detector within 2.5 s of the middle of a window of usable signal and of another elsewhere, thinned to one in 200 ms."""
    w = signal_quality(spark, sf).select(REC, F.col("window_idx").alias("slot"), F.col("is_usable").alias("usable"))
    ev = events(spark, sf).withColumn("slot", F.expr("case when t_ms < 2500 then -1 else (t_ms - 2500) div 5000 end"))
    ens = F.coalesce("usable", F.lit(False))
    own = ev.join(w, [REC, "slot"], "left").where(F.col("event_type") == F.when(ens, "click").otherwise("view"))
    return C.thin(own, 200)


#: Peaks of a frame that an onset is looked for before: local maxima over a level.
CREST = 0.1


def _crests(s: DataFrame) -> DataFrame:
    near = s.withColumn("a", F.lag("v").over(W.by("idx"))).withColumn("b", F.lead("v").over(W.by("idx")))
    return near.where((F.col("v") > F.col("a")) & (F.col("v") > F.col("b")) & (F.col("v") > CREST)).select(REC, F.col("idx").alias("peak"))


@query(f"""WITH {FS}, p AS (SELECT rec_id, idx AS p, lag(idx) OVER (PARTITION BY rec_id ORDER BY idx) AS q FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM fs WINDOW w AS (PARTITION BY rec_id ORDER BY idx)) WHERE v > a AND v > b AND v > {CREST})
SELECT p.rec_id, p::BIGINT AS peak, arg_min(idx, {{'v': v, 'i': idx}})::BIGINT AS onset FROM p JOIN fs ON fs.rec_id = p.rec_id AND idx >= coalesce(q, greatest(0, p - 50)) AND idx < p GROUP BY p.rec_id, p""")
def det17_onsets_between_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """The least sample since the peak before, or in the second before the first peak, as each peak's onset."""
    s = frame_samples(spark, sf).select(REC, "idx", "v")
    return P.onsets(s, _crests(s), 50)


PULSE = f"""WITH {FS}, cr AS (SELECT rec_id, idx AS p, lag(idx) OVER (PARTITION BY rec_id ORDER BY idx) AS q FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM fs WINDOW w AS (PARTITION BY rec_id ORDER BY idx)) WHERE v > a AND v > b AND v > {CREST}),
ri AS (SELECT cr.rec_id, p AS peak, arg_min(idx, {{'v': v, 'i': idx}}) AS onset FROM cr JOIN fs ON fs.rec_id = cr.rec_id AND idx >= coalesce(q, greatest(0, p - 50)) AND idx < p GROUP BY cr.rec_id, p),
pu AS (SELECT *, coalesce(lead(onset) OVER (PARTITION BY rec_id ORDER BY peak), peak) AS ending FROM ri), n AS (SELECT fs.rec_id, onset, peak, idx, v FROM pu JOIN fs ON fs.rec_id = pu.rec_id AND idx BETWEEN onset AND ending)"""


def _inside(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of all pulses of frames."""
    s = frame_samples(spark, sf).select(REC, "idx", "v")
    return P.pulse_samples(s, P.pulses(P.onsets(s, _crests(s), 50)))


@query(f"""{PULSE}, g AS (SELECT *, CASE WHEN idx = onset THEN lead(v) OVER w - v WHEN idx = peak THEN v - lag(v) OVER w ELSE (lead(v) OVER w - lag(v) OVER w) / 2 END AS s FROM n WHERE idx <= peak WINDOW w AS (PARTITION BY rec_id, onset ORDER BY idx)),
b AS (SELECT rec_id, onset, peak, arg_max({{'i': idx, 'v': v, 's': s}}, {{'s': s, 'i': -idx}}) AS b, arg_min(v, idx) AS base FROM g GROUP BY ALL)
SELECT rec_id, onset::BIGINT AS onset, round(CASE WHEN b.s > 0 THEN b.i + (base - b.v) / b.s ELSE onset END, 6) AS foot FROM b""")
def fea02_det18_tangent_foot(spark: SparkSession, sf: str) -> DataFrame:
    """Foot of every pulse, where the tangent of its steepest rise meets the level of the onset."""
    return P.tangent_foot(_inside(spark, sf)).select(REC, "onset", F.round(F.col("foot").cast("double"), 6).alias("foot"))


@query(f"""{PULSE}, g AS (SELECT *, lead(v) OVER (PARTITION BY rec_id, onset ORDER BY idx) - v AS s FROM n WHERE idx <= peak),
b AS (SELECT rec_id, onset, peak, arg_max({{'i': idx, 'v': v, 's': s}}, {{'s': s, 'i': -idx}}) FILTER (s IS NOT NULL) AS b, arg_min(v, idx) AS base FROM g GROUP BY ALL),
t AS (SELECT *, trunc(b.i + (base - b.v) / nullif(b.s, 0)) AS at_ FROM b) SELECT rec_id, onset::BIGINT AS onset, CASE WHEN peak - onset BETWEEN 3 AND 50 AND b.s > 0 AND at_ >= onset AND at_ < peak THEN at_ ELSE onset END::BIGINT AS refined FROM t""")
def det18_refined_onsets(spark: SparkSession, sf: str) -> DataFrame:
    """Onset of every pulse, moved to where the tangent of its steepest step meets its level."""
    return P.refined_onsets(_inside(spark, sf), 50.0).select(REC, "onset", "refined")


@query(f"""{PULSE}, e AS (SELECT rec_id, onset, max(v) FILTER (idx = onset) AS lo, max(v) FILTER (idx = peak) AS hi FROM n GROUP BY ALL), x AS (SELECT n.*, lo + 0.5 * (hi - lo) AS lvl, hi - lo AS amp, lag(v) OVER (PARTITION BY n.rec_id, n.onset ORDER BY idx) AS bf FROM n JOIN e USING (rec_id, onset)),
r AS (SELECT rec_id, onset, peak, any_value(amp) AS amp, arg_min({{'i': idx, 'v': v, 'b': bf, 'l': lvl}}, idx) FILTER (idx <= peak AND v >= lvl) AS r, arg_min({{'i': idx, 'v': v, 'b': bf, 'l': lvl}}, idx) FILTER (idx >= peak AND v <= lvl) AS f FROM x GROUP BY ALL),
w AS (SELECT rec_id, onset, amp, CASE WHEN f.i = peak THEN peak ELSE f.i - 1 + (f.l - f.b) / (f.v - f.b) END - CASE WHEN r.i = onset THEN onset ELSE r.i - 1 + (r.l - r.b) / (r.v - r.b) END AS w FROM r)
SELECT rec_id, onset::BIGINT AS onset, round(CASE WHEN amp > 0 AND w > 0 THEN w END, 6) AS pw50 FROM w""")
def fea03_half_width(spark: SparkSession, sf: str) -> DataFrame:
    """Width of every pulse at half of its height, between samples on the line."""
    return P.half_width(_inside(spark, sf)).select(REC, "onset", F.round("pw50", 6).alias("pw50"))


@query(f"{PULSE} SELECT rec_id, onset::BIGINT AS onset, (peak - onset)::BIGINT AS rise_time, round(max(v) FILTER (idx = peak) - max(v) FILTER (idx = onset), 6) AS rise_amp FROM n GROUP BY rec_id, onset, peak")
def fea04_rise(spark: SparkSession, sf: str) -> DataFrame:
    """Samples and height from each pulse's onset to its peak."""
    return P.rise(_inside(spark, sf)).select(REC, "onset", "rise_time", F.round("rise_amp", 6).alias("rise_amp"))


PAT = f"""WITH RECURSIVE {EV}, vw AS (SELECT * FROM ev WHERE event_type = 'view'), ck AS (SELECT * FROM ev WHERE event_type = 'click'),
a AS (SELECT r.rec_id, r.peak_id, r.t_ms, min(o.t_ms - r.t_ms) AS pat FROM vw r JOIN ck o ON o.rec_id = r.rec_id AND o.t_ms BETWEEN r.t_ms + 100 AND r.t_ms + 400 GROUP BY r.rec_id, r.peak_id, r.t_ms), o AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY t_ms, peak_id) AS k FROM a),
r AS (SELECT rec_id, k, peak_id, pat, true AS ok, [pat] AS acc FROM o WHERE k = 1 UNION ALL
 SELECT o.rec_id, o.k, o.peak_id, o.pat, NOT (len(acc) >= 3 AND abs(o.pat - list_sum(acc[-10:]) / len(acc[-10:])) > 20), CASE WHEN len(acc) >= 3 AND abs(o.pat - list_sum(acc[-10:]) / len(acc[-10:])) > 20 THEN acc ELSE list_append(acc, o.pat) END FROM r JOIN o ON o.rec_id = r.rec_id AND o.k = r.k + 1)"""


@query(f"{PAT} SELECT rec_id, peak_id, pat::DOUBLE AS pat_ms FROM r WHERE ok")
def fea01_pulse_arrival_time(spark: SparkSession, sf: str) -> DataFrame:
    """Delay from each R peak to its first foot 100-400 ms later, without jumps off the last ten accepted ones."""
    beats = peaks(spark, sf, "view").select(REC, "peak_id", F.col("t_ms").alias("r_ms"), (F.col("t_ms") + 100).alias("t_ms"))
    a = J.first_after(beats, peaks(spark, sf, "click"), {"t_ms": "foot"}).where("foot <= r_ms + 400")
    delays = a.select(REC, "r_ms", "peak_id", (F.col("foot") - F.col("r_ms")).cast("double").alias("pat"))
    return P.accepted_delays(delays, ["r_ms", "peak_id"]).select(REC, "peak_id", F.col("pat").alias("pat_ms"))


@query(f"""WITH {EV}, v AS (SELECT * FROM ev WHERE event_type = 'view'), p AS (SELECT * FROM ev WHERE event_type = 'purchase'), n AS (SELECT v.rec_id, v.peak_id, v.t_ms, v.value, max(p.t_ms) FILTER (p.t_ms <= v.t_ms) AS d, min(p.t_ms) AS f, count(p.t_ms) FILTER (p.t_ms <= v.t_ms) AS k FROM v JOIN p USING (rec_id) GROUP BY ALL)
SELECT rec_id, k AS dose_no, count(*) AS beats, round(min((t_ms - coalesce(d, f)) / 1000.0), 3) AS first_s, round(max((t_ms - coalesce(d, f)) / 1000.0), 3) AS last_s,
 ((200 * sum(round(value * 100)::BIGINT) + count(*)) // (2 * count(*))) / 10000.0 AS mean FROM n GROUP BY ALL""")
def fea06_snk05_by_medication(spark: SparkSession, sf: str) -> DataFrame:
    """Beats summed up by the dose that they follow; means of whole cents, rounded as whole numbers, are the same in any order."""
    doses = peaks(spark, sf, "purchase").withColumn("k", F.row_number().over(W.by("t_ms", "peak_id")))
    first = doses.groupBy(REC).agg(F.min("t_ms").alias("f"))
    # of doses at one time the last in order has the highest number
    got = J.last_before(peaks(spark, sf, "view").select(REC, "peak_id", "t_ms", "value"), doses, {"t_ms": "d", "k": "k"}).join(first, REC)
    since = (F.col("t_ms") - F.coalesce("d", "f")) / 1000
    mean = F.expr("(200 * sum(cast(round(value * 100) AS bigint)) + count(*)) div (2 * count(*)) / 10000")
    return got.groupBy(REC, F.coalesce("k", F.lit(0)).cast("long").alias("dose_no")).agg(F.count("*").alias("beats"), F.round(F.min(since), 3).alias("first_s"), F.round(F.max(since), 3).alias("last_s"), mean.alias("mean"))


@query(f"""WITH {FS}, p AS (SELECT rec_id, idx AS p FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM fs WINDOW w AS (PARTITION BY rec_id ORDER BY idx)) WHERE v > a AND v > b AND v > 0.15), d AS (SELECT fs.rec_id, idx, coalesce(min(abs(idx - p)), 64) AS d FROM fs LEFT JOIN p USING (rec_id) GROUP BY ALL)
SELECT rec_id, idx::BIGINT AS idx, round(d / 250.0, 6) AS scaled, round(CASE WHEN max(d) OVER w > min(d) OVER w THEN (d - min(d) OVER w) / (max(d) OVER w - min(d) OVER w) ELSE 0 END, 6) AS unit, round(1 - exp(-least(0.2 * d, 50)), 6) AS exponential FROM d WINDOW w AS (PARTITION BY rec_id)""")
def aug01_aug16_distance_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Distance maps as training targets: scaled, in unit range, and exponential."""
    from .joins import joi18_aug01_distance_to_peak

    d, w = joi18_aug01_distance_to_peak(spark, sf), Window.partitionBy(REC)
    lo, hi, x = F.min("dist").over(w), F.max("dist").over(w), F.col("dist")
    unit = F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(0.0)
    return d.select(REC, "idx", F.round(x / 250, 6).alias("scaled"), F.round(unit, 6).alias("unit"), F.round(1 - F.exp(-F.least(0.2 * x, F.lit(50.0))), 6).alias("exponential"))
