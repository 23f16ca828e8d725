"""Exact quantiles of large groups without a buffer of a group's values.

Equal values are counted first, by partial aggregates, so that a group that holds most rows is spread. Some thousand of its distinct
values, chosen by their hash, cut each group into ranges of about equally many values; within a range values are sorted and counted up,
and a table of one row for each range carries the counts along. The ranks asked for are then read off.

The cuts must come out the same whenever a plan works them out, as the counts of ranges and the values in them are two branches of it.
A sketch of all values would not do: it depends on the order in which parts are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan
from .windows import KEY

#: Ranges of a group, values that its cuts are taken from, and an accuracy at which percentile_approx() keeps all of these.
RANGES, PICKED, ACCURACY = 64, 4096, 1_000_000


def quantiles(values: DataFrame, probs: list[float], v: str = "v", ranges: int = RANGES) -> DataFrame:
    """rec_id, q: an array with each of the quantiles of values(rec_id, v) on the line between neighbouring ranks, as percentile()
    gives them. Nulls don't count, NaN is the greatest value; a recording without values has no row."""
    own = values.where(F.col(v).isNotNull()).select(KEY, F.col(v).cast("double").alias("_v"))
    counts = own.groupBy(KEY, "_v").agg(F.count("*").alias("_n"))
    cuts = [(i + 1) / ranges for i in range(ranges - 1)]
    sizes = counts.groupBy(KEY).agg(F.sum("_n").alias("_all"), F.count("*").alias("_distinct"))
    every = F.greatest(F.lit(1), F.ceil(F.col("_distinct") / PICKED))
    picked = counts.join(sizes, KEY).where(F.pmod(F.xxhash64("_v"), every) == 0)
    borders = sizes.join(picked.groupBy(KEY).agg(F.percentile_approx("_v", cuts, ACCURACY).alias("_cuts")), KEY, "left")
    below = F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c <= F.col("_v")))
    rows = counts.join(borders, KEY).withColumn("_bin", below).select(KEY, "_v", "_n", "_all", "_bin")
    rows = scan.running(rows, ["_v"], F.col("_bin"), {"_upto": F.col("_n")})
    place = lambda p: p * (F.col("_all") - 1)
    ranks = [f(place(p)) for p in probs for f in (F.floor, F.ceil)]
    held = lambda r: F.max(F.when((F.col("_upto") - F.col("_n") <= r) & (r < F.col("_upto")), F.col("_v")))
    found = rows.groupBy(KEY).agg(F.first("_all").alias("_all"), *[held(r).alias(f"_{i}") for i, r in enumerate(ranks)])

    def between(i: int, p: float) -> Column:
        lo, hi, at = F.col(f"_{2 * i}"), F.col(f"_{2 * i + 1}"), place(p)
        return F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi)

    return found.select(KEY, F.array(*[between(i, p) for i, p in enumerate(probs)]).alias("q"))


def median(values: DataFrame, v: str = "v", name: str = "median") -> DataFrame:
    """rec_id and the median of values(rec_id, v)."""
    return quantiles(values, [0.5], v).select(KEY, F.col("q")[0].alias(name))
