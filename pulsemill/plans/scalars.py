"""PRJ and FLT: projections and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import fills, selection as O
from .bindings import EV, FS, SM, events, frame_samples, samples
from .registry import query

REC = "rec_id"

T = f"WITH {EV}"


def _whole() -> WindowSpec:
    return Window.partitionBy(REC)


@query(f"""WITH {SM}, u AS (SELECT rec_id, idx, (l_orderkey * 7919 + l_partkey * 104729) & 16777215 AS u FROM sm),
s AS (SELECT rec_id, idx, CASE WHEN ((u >> 3) & 7) IN (0, 1, 2) THEN floor((CASE WHEN u >= 8388608 THEN u - 16777216 ELSE u END) / 64.0) * (1000.0::DOUBLE / 2621440) END AS v FROM u),
a AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN idx END IGNORE NULLS) OVER b AS bi, last_value(v IGNORE NULLS) OVER b AS bv, first_value(CASE WHEN v IS NOT NULL THEN idx END IGNORE NULLS) OVER f AS ai, first_value(v IGNORE NULLS) OVER f AS av
  FROM s WINDOW b AS (PARTITION BY rec_id ORDER BY idx), f AS (PARTITION BY rec_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT rec_id, idx, coalesce(v, CASE WHEN bi = ai THEN bv ELSE bv + (av - bv) * (idx - bi) / (ai - bi) END, bv, av, 0) AS v FROM a)
SELECT rec_id, idx, round(v - avg(v) OVER (PARTITION BY rec_id), 6) AS mv FROM l""")
def prj01_decode_words(spark: SparkSession, sf: str) -> DataFrame:
    """Tag and signed value of the words of a front-end chip."""
    raw = F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729
    s = samples(spark, sf).select(REC, "idx", S.decode_word(raw).alias("v"))
    return fills.interpolate(s, empty=0.0).select(REC, "idx", F.round(F.col("v") - F.avg("v").over(_whole()), 6).alias("mv"))


@query(f"""WITH {SM}, m AS (SELECT *, quantile_cont(v, 0.5) OVER p AS md FROM sm WINDOW p AS (PARTITION BY rec_id)), d AS (SELECT *, quantile_cont(abs(v - md), 0.5) OVER (PARTITION BY rec_id) AS mad, avg(v) OVER (PARTITION BY rec_id) AS mean FROM m)
SELECT rec_id, idx, round(CASE WHEN mad > 1e-9 THEN (v - md) / (1.4826 * mad) ELSE v - mean END, 6) AS z FROM d""")
def prj02_src04_robust_z(spark: SparkSession, sf: str) -> DataFrame:
    """Median and deviation are selected and joined back: a window of percentiles would hold each series for every row."""
    s = samples(spark, sf).select(REC, "idx", "v")
    md = O.median(s, name="md").join(s.groupBy(REC).agg(F.avg("v").alias("mean")), REC)
    mad = O.median(s.join(md, REC).select(REC, F.abs(F.col("v") - F.col("md")).alias("d")), "d", "mad")
    z = F.when(F.col("mad") > 1e-9, (F.col("v") - F.col("md")) / (1.4826 * F.col("mad"))).otherwise(F.col("v") - F.col("mean"))
    return s.join(md, REC).join(mad, REC).select(REC, "idx", F.round(z, 6).alias("z"))


@query(f"""WITH {FS}, s AS (SELECT *, avg(v) OVER p AS m, stddev_pop(v) OVER p AS sd, min(v) OVER p AS lo, max(v) OVER p AS hi FROM fs WINDOW p AS (PARTITION BY rec_id))
SELECT rec_id, idx::BIGINT AS idx, round(CASE WHEN sd > 1e-6 THEN (v - m) / sd ELSE v - m END, 6) AS z, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END, 6) AS unit, round(v / hi, 6) AS of_max FROM s""")
def prj03_prj04_prj05_prj06_normalised(spark: SparkSession, sf: str) -> DataFrame:
    """z-score, unit range and share of the maximum of every record, from one sort."""
    v = F.col("v")
    return frame_samples(spark, sf).select(REC, "idx", F.round(S.z_score(v, _whole()), 6).alias("z"), F.round(S.min_max(v, _whole()), 6).alias("unit"), F.round(v / F.max(v).over(_whole()), 6).alias("of_max"))


@query(f"{T} SELECT rec_id, peak_id, TRY_CAST(regexp_extract(props, ':\\s*([^}}]*)', 1) AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS none_ FROM ev")
def prj07_numeric_coercion(spark: SparkSession, sf: str) -> DataFrame:
    """Cells as numbers, null where they are none."""
    return events(spark, sf).select(REC, "peak_id", F.trim(F.regexp_extract("props", r":\s*([^}]*)", 1)).try_cast("double").alias("k"), F.col("event_type").try_cast("double").alias("none_"))


SKEW = "(avg(v * v * v) - 3 * avg(v) * avg(v * v) + 2 * avg(v) * avg(v) * avg(v)) / pow(stddev_pop(v), 3)"


@query(f"""WITH {FS}, k AS (SELECT rec_id, {SKEW} AS s FROM fs GROUP BY rec_id) SELECT rec_id, idx::BIGINT AS idx, round(CASE WHEN s < -0.1 THEN -v ELSE v END, 6) AS v, s < -0.1 AS inverted FROM fs JOIN k USING (rec_id)""")
def prj08_prj09_auto_invert(spark: SparkSession, sf: str) -> DataFrame:
    """Frames that point down turned over."""
    flip = F.skewness("v").over(_whole()) < -0.1
    return frame_samples(spark, sf).select(REC, "idx", F.round(F.when(flip, -F.col("v")).otherwise(F.col("v")), 6).alias("v"), flip.alias("inverted"))


@query(f"""WITH labels_ AS (SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'Drug dose ' WHEN event_type = 'signup' THEN 'medication intake ' ELSE 'cow ' END || props AS label FROM events)
SELECT event_id, regexp_matches(label, '(?i)medication intake|drug') AS is_dose, TRY_CAST(regexp_extract(label, '(\\d+)', 1) AS INTEGER) AS number FROM labels_""")
def prj12_label_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Labels that say a dose was taken, and the first number in them."""
    kind = F.when(F.col("event_type") == "purchase", "Drug dose ").when(F.col("event_type") == "signup", "medication intake ").otherwise("cow ")
    label = F.concat(kind, "props")
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", S.is_dose(label).alias("is_dose"), S.first_number(label).alias("number"))


@query("""SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') AS name, split_part(url, '/', 3) AS host, regexp_replace(url, '\\.[A-Za-z0-9]+$', '') AS stem FROM pages""")
def prj13_safe_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names that are safe as files, hosts and stems of paths."""
    url = F.col("url")
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", S.safe_name(url).alias("name"), F.split_part(url, F.lit("/"), F.lit(3)).alias("host"), F.regexp_replace(url, r"\.[A-Za-z0-9]+$", "").alias("stem"))


@query(f"""WITH {SM}, q AS (SELECT rec_id, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM sm GROUP BY rec_id) SELECT rec_id, idx, round(least(greatest(v, lo), hi), 6) AS v FROM sm JOIN q USING (rec_id)""")
def prj14_quantile_clip(spark: SparkSession, sf: str) -> DataFrame:
    """Samples held between two quantiles of their series."""
    s = samples(spark, sf)
    q = O.quantiles(s, [0.005, 0.995]).withColumnRenamed("q", "ends")
    return s.join(q, REC).select(REC, "idx", F.round(F.least(F.greatest(F.col("v"), F.col("ends")[0]), F.col("ends")[1]), 6).alias("v"))


@query(f"WITH {FS} SELECT rec_id, idx::BIGINT AS idx, round(sin(v), 9) AS s, round(exp(v), 9) AS e, round(log10(abs(v) + 1), 9) AS l, round(sqrt(abs(v)), 9) AS r, sign(v)::INTEGER AS g, round(least(greatest(v, -0.1), 0.1), 9) AS c FROM fs")
def prj15_math(spark: SparkSession, sf: str) -> DataFrame:
    """Elementary functions of the samples."""
    v = F.col("v")
    return frame_samples(spark, sf).select(REC, "idx", F.round(F.sin(v), 9).alias("s"), F.round(F.exp(v), 9).alias("e"), F.round(F.log10(F.abs(v) + 1), 9).alias("l"), F.round(F.sqrt(F.abs(v)), 9).alias("r"), F.signum(v).cast("int").alias("g"), F.round(F.least(F.greatest(v, F.lit(-0.1)), F.lit(0.1)), 9).alias("c"))


@query(f"""{T}, k AS (SELECT rec_id, count(*) AS n, quantile_cont(value, 0.5) AS md, stddev_pop(value) AS sd FROM ev GROUP BY rec_id)
SELECT rec_id, peak_id, value FROM ev JOIN k USING (rec_id) WHERE n < 3 OR (value >= md - 1.5 * sd AND value <= md + 1.5 * sd)""")
def flt04_amplitude_outliers(spark: SparkSession, sf: str) -> DataFrame:
    """Peaks within 1.5 standard deviations of the median amplitude, where there are three or more."""
    ev = events(spark, sf)
    k = ev.groupBy(REC).agg(F.count("*").alias("n"), F.stddev_pop("value").alias("sd")).join(O.median(ev, "value", "md"), REC)
    near = F.col("value").between(F.col("md") - 1.5 * F.col("sd"), F.col("md") + 1.5 * F.col("sd"))
    return ev.join(k, REC).where((F.col("n") < 3) | near).select(REC, "peak_id", "value")


@query(f"""WITH {FS}, w AS (SELECT rec_id, (idx // 16)::BIGINT AS window_idx, max(v) - min(v) AS ptp FROM fs GROUP BY ALL) SELECT rec_id, window_idx, round(ptp, 6) AS ptp, ptp >= 0.3 AS worn FROM w""")
def flt05_agg18_worn_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Windows whose range says that the device was worn."""
    w = frame_samples(spark, sf).groupBy(REC, F.expr("idx div 16").alias("window_idx")).agg((F.max("v") - F.min("v")).alias("ptp"))
    return w.select(REC, "window_idx", F.round("ptp", 6).alias("ptp"), (F.col("ptp") >= 0.3).alias("worn"))


@query(f"""{T} SELECT DISTINCT rec_id, t_ms FROM ev WHERE event_type IN ('view', 'click') AND t_ms BETWEEN 500 AND 9500""")
def flt07_flt08_beat_whitelist_and_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Annotations that are beats and lie off the edges."""
    return events(spark, sf).where(F.col("event_type").isin("view", "click") & F.col("t_ms").between(500, 9500)).select(REC, "t_ms").distinct()


@query(f"""{T}, p AS (SELECT rec_id, avg(value) FILTER (event_type = 'click') AS ref_hr, avg(value) FILTER (event_type = 'view') AS test_hr FROM ev GROUP BY rec_id) SELECT rec_id, round(test_hr - ref_hr, 5) AS err FROM p WHERE ref_hr > 0 AND test_hr > 0""")
def flt09_valid_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of which both sides are positive."""
    mean = lambda k: F.avg(F.when(F.col("event_type") == k, F.col("value")))
    p = events(spark, sf).groupBy(REC).agg(mean("click").alias("ref_hr"), mean("view").alias("test_hr"))
    return p.where("ref_hr > 0 and test_hr > 0").select(REC, F.round(F.col("test_hr") - F.col("ref_hr"), 5).alias("err"))


@query(f"WITH {SM} SELECT rec_id, idx, v FROM sm WHERE idx >= 100 AND idx < 300 AND idx % 7 = 0")
def flt11_flt12_slice_and_thin(spark: SparkSession, sf: str) -> DataFrame:
    """A slice of time, and every k-th sample of it."""
    return samples(spark, sf).where("idx >= 100 and idx < 300 and idx % 7 = 0").select(REC, "idx", "v")


@query(f"WITH {FS}, s AS (SELECT rec_id, idx, CASE WHEN abs(v) < 0.02 THEN -99.0 ELSE v END AS v FROM fs) SELECT rec_id, count(*) FILTER (v <> -99) AS n_valid, count(*) FILTER (v = -99) AS n_invalid FROM s GROUP BY rec_id")
def flt01_invalid_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Samples that are missing or not finite."""
    v = S.valid(F.when(F.abs("v") < 0.02, F.lit(S.MISSING)).otherwise(F.col("v")))
    return frame_samples(spark, sf).select(REC, v.alias("v")).groupBy(REC).agg(F.count("v").alias("n_valid"), (F.count("*") - F.count("v")).alias("n_invalid"))
