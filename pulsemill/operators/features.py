"""Features of pulses, on samples(rec_id, idx, v) and pulses(rec_id, onset, peak, end).

A pulse goes from its onset over its peak to its end, the next onset. The pulses of a recording lie one after the other: one may
begin where another ends. A pulse is named by its recording and onset, and is worked on by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import folds, scan
from .windows import KEY, by

PULSE = [KEY, "onset"]


def _along() -> Window:
    return Window.partitionBy(*PULSE).orderBy("idx")


def pulses(rises: DataFrame) -> DataFrame:
    """rec_id, onset, peak, end for rises(rec_id, onset, peak), one for each pulse: it ends at the next onset at or after its peak's
    place; the last of a recording ends at its peak."""
    return rises.select(KEY, "onset", "peak", F.coalesce(F.lead("onset").over(by("peak")), "peak").alias("end"))


def pulse_samples(samples: DataFrame, pulses: DataFrame, width: float = scan.RANGE_SAMPLES) -> DataFrame:
    """The samples of each pulse from its onset to its end, both included, with the pulse's columns. A sample at which one pulse ends
    and another begins is in both.

    One sort of samples and onsets, range by range, gives each sample the last onset at or before it, and with it the pulse before.
    Of the pulses alone, about one a second, a recording is one sort.
    """
    place = F.struct("onset", "peak", "end")
    marks = pulses.select(KEY, "onset", "peak", "end").withColumn("_last", F.lag(place).over(by("onset")))
    marks = marks.select(KEY, F.col("onset").alias("_at"), F.lit(0).alias("_side"), F.struct(place.alias("own"), F.col("_last").alias("last")).alias("_mark"), F.lit(None).cast("double").alias("_v"))
    rows = samples.select(KEY, F.col("idx").alias("_at"), F.lit(1).alias("_side"), F.lit(None).alias("_mark"), F.col("v").cast("double").alias("_v"))
    both = scan.carried(rows.unionByName(marks), ["_at", "_side"], scan.every("_at", width), {"_got": F.col("_mark")}, marked=marks).where("_side = 1")
    near = F.filter(F.array("_got.own", "_got.last"), lambda p: (F.col("_at") >= p["onset"]) & (F.col("_at") <= p["end"]))
    return both.select(KEY, F.col("_at").alias("idx"), F.col("_v").alias("v"), F.explode(near).alias("p")).select(KEY, "idx", "v", "p.*")


def _rise(inside: DataFrame) -> DataFrame:
    """The samples up to each pulse's peak, with those before and after."""
    rise = inside.where("idx <= peak")
    return rise.withColumns({"_before": F.lag("v").over(_along()), "_after": F.lead("v").over(_along())})


def tangent_foot(inside: DataFrame) -> DataFrame:
    """rec_id, onset, peak, foot for each pulse of inside = pulse_samples(...): where the tangent at the steepest rise meets the level
    of the onset; the onset without a rise.

    Slopes are central inside the rise and one-sided at its ends.
    """
    slope = F.when(F.col("idx") == F.col("onset"), F.col("_after") - F.col("v")).when(F.col("idx") == F.col("peak"), F.col("v") - F.col("_before")).otherwise((F.col("_after") - F.col("_before")) / 2)
    best = _rise(inside).withColumn("slope", slope).groupBy(*PULSE, "peak").agg(F.max_by(F.struct("idx", "v", "slope"), F.struct("slope", (-F.col("idx")).alias("i"))).alias("b"), F.min_by("v", "idx").alias("base"))
    foot = F.col("b.idx") + F.try_divide(F.col("base") - F.col("b.v"), F.col("b.slope"))
    return best.select(*PULSE, "peak", F.when(F.col("b.slope") > 0, foot).otherwise(F.col("onset")).alias("foot"))


def refined_onsets(inside: DataFrame, fs: float) -> DataFrame:
    """rec_id, onset, peak, refined for each pulse: where the tangent of the steepest step from a sample to the next meets the level of
    the onset, cut to a whole sample. The onset itself where the rise takes over a second or fewer than four samples, does not rise,
    or where the tangent meets it before the onset or not before the peak."""
    step = F.col("_after") - F.col("v")
    steps = _rise(inside).withColumn("step", step)
    best = steps.groupBy(*PULSE, "peak").agg(F.max_by(F.struct("idx", "v", "step"), F.when(F.col("step").isNotNull(), F.struct("step", (-F.col("idx")).alias("i")))).alias("b"), F.min_by("v", "idx").alias("base"))
    at = (F.col("b.idx") + F.try_divide(F.col("base") - F.col("b.v"), F.col("b.step"))).cast("long")
    rise = F.col("peak") - F.col("onset")
    good = (rise <= fs) & (rise >= 3) & (F.col("b.step") > 0) & (at >= F.col("onset")) & (at < F.col("peak"))
    return best.select(*PULSE, "peak", F.when(good, at).otherwise(F.col("onset")).alias("refined"))


def half_width(inside: DataFrame) -> DataFrame:
    """rec_id, onset, peak, pw50 for each pulse: time from the first sample at half height or more on the rise to the first at half or
    less on the fall, both on the line from the sample before; null without a crossing or a rise."""
    at = lambda c: F.max(F.when(F.col("idx") == F.col(c), F.col("v"))).over(Window.partitionBy(*PULSE))
    x = inside.withColumns({"lo": at("onset"), "hi": at("peak"), "before": F.lag("v").over(_along())}).withColumn("level", F.col("lo") + 0.5 * (F.col("hi") - F.col("lo")))

    def first(cond: Column) -> Column:
        return F.min(F.when(cond, F.struct("idx", "v", "before", "level")))

    c = x.groupBy(*PULSE, "peak").agg(first((F.col("idx") <= F.col("peak")) & (F.col("v") >= F.col("level"))).alias("r"), first((F.col("idx") >= F.col("peak")) & (F.col("v") <= F.col("level"))).alias("f"), F.first(F.col("hi") - F.col("lo")).alias("amp"))

    def crossing(s: str, start: str) -> Column:
        frac = F.coalesce(F.try_divide(F.col(f"{s}.level") - F.col(f"{s}.before"), F.col(f"{s}.v") - F.col(f"{s}.before")), F.lit(0.0))
        return F.when(F.col(f"{s}.idx") == F.col(start), F.col(start)).otherwise(F.col(f"{s}.idx") - 1 + frac)

    width = crossing("f", "peak") - crossing("r", "onset")
    return c.select(*PULSE, "peak", F.when((F.col("amp") > 0) & (width > 0), width).alias("pw50"))


def rise(inside: DataFrame) -> DataFrame:
    """rec_id, onset, peak, rise_time (samples), rise_amp from each pulse's onset to its peak."""
    at = lambda c: F.max(F.when(F.col("idx") == F.col(c), F.col("v")))
    return inside.groupBy(*PULSE, "peak").agg((at("peak") - at("onset")).alias("rise_amp")).withColumn("rise_time", (F.col("peak") - F.col("onset")).cast("long"))


def accepted_delays(delays: DataFrame, order: list[str], keep: int = 10, least: int = 3, most: float = 20.0) -> DataFrame:
    """Of delays(rec_id, pat, ...) those accepted, in the order of the columns `order`: once `least` are, a delay more than `most` from
    the mean of the last `keep` accepted ones is not."""
    return folds.fold(delays, [KEY], order, "pat", folds.steady(keep, least, most))


def onsets(samples: DataFrame, crests: DataFrame, back: int) -> DataFrame:
    """rec_id, peak, onset for crests(rec_id, peak) of samples(rec_id, idx, v): the place of the least sample, of equal ones the
    first, from the peak before, or from `back` samples before the first peak. A peak with no sample before it has none.

    A sample belongs to the first peak after it, found in one sort of both, range by range of a recording.
    """
    both = samples.select(KEY, F.col("idx").alias("_at"), F.lit(1).alias("_side"), F.col("v").alias("_v")).unionByName(crests.select(KEY, F.col("peak").alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast("double").alias("_v")))
    mark, order, at = F.when(F.col("_side") == 0, F.col("_at")), ["_at", "_side"], scan.every("_at", scan.RANGE_SAMPLES)
    # a sample at a peak's own place comes after its mark, and so belongs to the next one
    rows = scan.carried(both, order, at, {"_before": mark}, {"peak": mark}).where("_side = 1 and peak is not null")
    rows = rows.where(F.col("_before").isNotNull() | (F.col("_at") >= F.col("peak") - back))
    return rows.groupBy(KEY, "peak").agg(F.min_by("_at", F.struct("_v", "_at")).alias("onset"))
