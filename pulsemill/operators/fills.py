"""Filling of invalid samples and resampling on regular grids, for samples(rec_id, idx, v) with null for invalid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan
from .windows import KEY


def _around(df: DataFrame, x: str, vs: list[str], order: tuple[str, ...] = (), width: float = scan.RANGE_SAMPLES) -> DataFrame:
    """df with, for each column v of vs, _b_v and _a_v: the place and value of the last valid sample at or before a row and of the
    first at or after it."""
    own = {v: F.when(F.col(v).isNotNull(), F.struct(F.col(x).alias("x"), F.col(v).alias("v"))) for v in vs}
    return scan.carried(df, list(order or (x,)), scan.every(x, width), {f"_b_{v}": m for v, m in own.items()}, {f"_a_{v}": m for v, m in own.items()}, marks_by=[x])


def _line(at: Column, v: str) -> Column:
    b, a = F.col(f"_b_{v}"), F.col(f"_a_{v}")
    return F.when(b["x"] == a["x"], b["v"]).otherwise(b["v"] + (a["v"] - b["v"]) * (at - b["x"]) / (a["x"] - b["x"]))


def interpolate(df: DataFrame, x: str = "idx", v: str | list[str] = "v", empty: float | None = None, width: float = scan.RANGE_SAMPLES) -> DataFrame:
    """Nulls of one column, or of several, on the line between their valid neighbours, constant beyond the ends; `empty` where
    none is valid."""
    vs = [v] if isinstance(v, str) else v
    filled = {v: F.coalesce(F.col(v), _line(F.col(x), v), F.col(f"_b_{v}")["v"], F.col(f"_a_{v}")["v"], F.lit(empty).cast("double")) for v in vs}
    return _around(df, x, vs, width=width).withColumns(filled).drop(*[f"_{s}_{v}" for v in vs for s in "ba"])


def interpolate_limited(df: DataFrame, limit: int, x: str = "idx", v: str | list[str] = "v") -> DataFrame:
    """At most `limit` nulls of each gap on the line (after the last valid sample: its value), the rest from the next valid
    sample, then from the last; of one column, or of several."""
    vs = [v] if isinstance(v, str) else v

    def filled(v: str) -> Column:
        before, after = F.col(f"_b_{v}"), F.col(f"_a_{v}")
        line = F.when(F.col(x) - before["x"] <= limit, F.coalesce(_line(F.col(x), v), before["v"]))
        return F.coalesce(F.col(v), line, after["v"], before["v"])

    return _around(df, x, vs).withColumns({v: filled(v) for v in vs}).drop(*[f"_{s}_{v}" for v in vs for s in "ba"])


def on_grid(points: DataFrame, grid: DataFrame, x: str = "x", v: str = "v") -> DataFrame:
    """rec_id, x, v on the grid's places by linear interpolation between points; constant beyond the ends."""
    both = points.select(KEY, x, v, F.lit(False).alias("_grid")).unionByName(grid.select(KEY, x, F.lit(None).cast("double").alias(v), F.lit(True).alias("_grid")))
    filled = F.coalesce(F.col(v), _line(F.col(x), v), F.col(f"_b_{v}")["v"], F.col(f"_a_{v}")["v"])
    return _around(both, x, [v], (x, "_grid")).withColumn(v, filled).where("_grid").select(KEY, x, v)
