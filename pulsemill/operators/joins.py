"""As-of, nearest and interval joins on a recording's clock.

Range joins are equi-joins on the recording and a time bucket: the side with the interval is repeated for the buckets
that it touches, so that no plan compares all pairs of a recording. As-of joins are one sort of the union of both
sides, range by range of the clock. Peaks are (rec_id, peak_id, t_ms); ties on the clock go by peak_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan

KEY = "rec_id"


def band_join(left: DataFrame, right: DataFrame, lo: str, hi: str, at: str, width: int, how: str = "inner") -> DataFrame:
    """Rows of left with the rows of right of the same recording whose `at` lies in [lo, hi]; width is about hi - lo.

    Both sides may share only the column rec_id. how: inner, left_semi or left_anti; for an outer join, join the
    aggregate of the inner one back.
    """
    bucket = F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))
    if how == "inner":
        wide = left.withColumn("_bucket", F.explode(bucket))
        return wide.join(right.withColumn("_bucket", F.floor(F.col(at) / width)), [KEY, "_bucket"]).where((F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi))).drop("_bucket")
    # the interval side may be repeated, but a semi-join must keep one row: repeat the points instead of the rows
    points = right.select(KEY, F.col(at).alias("_at"), F.explode(F.array(F.floor(F.col(at) / width))).alias("_bucket")).distinct()
    named = left.withColumn("_row", F.struct(*[F.col(c) for c in left.columns]))
    hit = named.select(KEY, lo, hi, "_row", F.explode(bucket).alias("_bucket")).join(points, [KEY, "_bucket"]).where((F.col("_at") >= F.col(lo)) & (F.col("_at") <= F.col(hi))).select("_row").distinct()
    return named.join(hit, "_row", how).drop("_row")


def last_before(rows: DataFrame, marks: DataFrame, out: dict[str, str], at: str = "t_ms", order: str = "peak_id", strict: bool = False, width: float = scan.RANGE_MS) -> DataFrame:
    """As-of, backward: rows with the columns of the latest mark at or before them (strict: before them).

    out: mark column -> name of the new column. marks need rec_id, `at` and `order`. Tasks sort ranges of `width` of the clock.
    """
    return _asof(rows, marks, out, at, order, False, strict, width)


def first_after(rows: DataFrame, marks: DataFrame, out: dict[str, str], at: str = "t_ms", order: str = "peak_id", strict: bool = False, width: float = scan.RANGE_MS) -> DataFrame:
    """As-of, forward: rows with the columns of the first mark at or after them (strict: after them)."""
    return _asof(rows, marks, out, at, order, True, strict, width)


def _asof(rows: DataFrame, marks: DataFrame, out: dict[str, str], at: str, order: str, forward: bool, strict: bool, width: float) -> DataFrame:
    own = F.struct(*[F.col(c) for c in rows.columns])
    mark = F.struct(*[F.col(c).alias(n) for c, n in out.items()])
    # at equal times a mark stands where the scan sees it, or, if the join is strict, where it doesn't
    first = forward == strict
    side = rows.select(KEY, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.col(order).alias("_order"), own.alias("_row"), F.lit(None).alias("_mark"))
    other = marks.select(KEY, F.col(at).alias("_at"), F.lit(0 if first else 2).alias("_side"), F.col(order).alias("_order"), F.lit(None).alias("_row"), mark.alias("_mark"))
    got = {"_got": F.col("_mark")}
    both = scan.carried(side.unionByName(other), ["_at", "_side", "_order"], scan.every("_at", width), None if forward else got, got if forward else None, other)
    return both.where("_side = 1").select("_row.*", "_got.*")


def nearest(rows: DataFrame, refs: DataFrame, out: dict[str, str], at: str = "t_ms", order: str = "peak_id") -> DataFrame:
    """rows with the columns of the ref nearest in time; between two equally near refs the earlier one, and of refs at one
    time the least in order."""
    before = {c: f"_b_{n}" for c, n in out.items()} | {"_t": "_b_at"}
    after = {c: f"_a_{n}" for c, n in out.items()} | {"_t": "_a_at"}
    # of refs at one time only the least in order can be nearest
    least = refs.groupBy(KEY, at).agg(F.min_by(F.struct(*[F.col(c) for c in {*out, order}]), order).alias("_r")).select(KEY, at, *[F.col("_r")[c].alias(c) for c in {*out, order} - {KEY, at}], F.col(at).alias("_t"))
    both = first_after(last_before(rows, least, before, at, order), least, after, at, order)
    back = F.col("_a_at").isNull() | (F.col(at) - F.col("_b_at") <= F.col("_a_at") - F.col(at))
    back = F.col("_b_at").isNotNull() & back
    return both.select(*rows.columns, *[F.when(back, F.col(f"_b_{n}")).otherwise(F.col(f"_a_{n}")).alias(n) for n in out.values()])


def matched(test: DataFrame, refs: DataFrame, tolerance: int) -> DataFrame:
    """Each test peak with its nearest ref, where that is at most tolerance away: rec_id, peak_id, ref_id."""
    near = nearest(test, refs, {"peak_id": "ref_id", "t_ms": "ref_ms"})
    return near.where(F.abs(F.col("t_ms") - F.col("ref_ms")) <= tolerance).select(KEY, "peak_id", "ref_id")


def beat_counts(test: DataFrame, refs: DataFrame, tolerance: int) -> DataFrame:
    """rec_id, n_ref, n_test, tp, fp, fn. A ref counts once, however many test peaks have it as their nearest."""
    tp = matched(test, refs, tolerance).groupBy(KEY).agg(F.countDistinct("ref_id").alias("tp"))
    n_ref = refs.groupBy(KEY).agg(F.count("*").alias("n_ref"))
    n_test = test.groupBy(KEY).agg(F.count("*").alias("n_test"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    all_ = n_ref.join(n_test, KEY, "full").join(tp, KEY, "left").select(KEY, zero("n_ref"), zero("n_test"), zero("tp"))
    return all_.select("*", (F.col("n_test") - F.col("tp")).alias("fp"), (F.col("n_ref") - F.col("tp")).alias("fn"))


def rates(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """se, ppv and f1 with the small terms that keep empty cases at zero, to four digits."""
    se, ppv = tp / (tp + fn + 1e-9), tp / (tp + fp + 1e-9)
    return [F.round(se, 4).alias("se"), F.round(ppv, 4).alias("ppv"), F.round(2 * se * ppv / (se + ppv + 1e-9), 4).alias("f1")]
