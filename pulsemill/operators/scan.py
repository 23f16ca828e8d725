"""Running values along recordings of any length: prefix scans over ranges.

A recording is cut into ranges of its clock. Each range is scanned by itself, a small table of what ranges end with is carried
on along each recording, and every row adds what came before its range. So a task sorts a range, not a recording, and what is
sorted by recording is one row for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .windows import KEY

#: Length of a range: an hour in ms, and samples.
RANGE_MS, RANGE_SAMPLES = 3_600_000, 1 << 20
RANGE = "_range"


def by_range(rows: DataFrame, at: Column) -> DataFrame:
    """rows with the recording and number of the range that `at` says, as one column that is never null."""
    return rows.withColumn(RANGE, F.struct(F.col(KEY).alias("of"), at.alias("k")))


def every(x: Column | str, width: float) -> Column:
    """Number of the range of a place on a clock."""
    return F.floor((F.col(x) if isinstance(x, str) else x) / width)


def _along() -> Window:
    return Window.partitionBy(f"{RANGE}.of").orderBy(f"{RANGE}.k")


def running(rows: DataFrame, order: list[str], at: Column, sums: dict[str, Column], number: str | None = None) -> DataFrame:
    """rows with the running sum of each column of `sums` (nulls add nothing) up to the row and its own included, and with
    `number`, how many rows come before it, in the order of the columns `order`; `at` numbers ranges in that order."""
    rows = by_range(rows, at)
    values = dict(sums) | ({number: F.lit(1).cast("long")} if number else {})
    rows = rows.withColumns({f"_x_{n}": x for n, x in values.items()})
    local = Window.partitionBy(RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(RANGE).agg(*[F.sum(f"_x_{n}").alias(f"_t_{n}") for n in values])
    before = _along().rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(RANGE, *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in values])
    own = rows.withColumns({f"_x_{n}": F.sum(f"_x_{n}").over(local) for n in values}).join(offsets, RANGE, "left")
    zero = F.lit(0)
    out = {n: F.coalesce(F.col(f"_x_{n}") + F.coalesce(f"_o_{n}", zero), f"_x_{n}", f"_o_{n}") - (1 if n == number else 0) for n in values}
    return own.withColumns(out).drop(RANGE, *[f"_{k}_{n}" for n in values for k in "xo"])


def carried(rows: DataFrame, order: list[str], at: Column, back: dict[str, Column] | None = None, ahead: dict[str, Column] | None = None, marked: DataFrame | None = None, marks_by: list[str] | None = None) -> DataFrame:
    """rows with, for each of back (new column -> value, null where a row is no mark), the last value at or before the row in the
    order of the columns `order`, and for each of ahead the first at or after it; `at` numbers ranges in that order. Marks of
    both are told in one scan. marked: those of rows that can be marks, where they are known apart, so that what else there
    is need not be worked out twice. marks_by: those of the columns of `order` that tell marks apart, if fewer do."""
    values = {("b", n): x for n, x in (back or {}).items()} | {("a", n): x for n, x in (ahead or {}).items()}
    of = {key: f"_{key[0]}_{key[1]}" for key in values}
    # what marks both ways is held once
    first = {}
    mark = {key: first.setdefault(id(x), f"_m{of[key]}") for key, x in values.items()}
    ready = lambda df: by_range(df, at).withColumns({mark[k]: x for k, x in values.items()})
    rows, w = ready(rows), Window.partitionBy(RANGE).orderBy(*order)
    kinds, told = {f.name: f.dataType for f in rows.schema}, marks_by or order

    def end(k: tuple[str, str]) -> Column:
        """The mark that is last or first in a range, field by field, so that numbers are aggregated without a sort."""
        m, pick = mark[k], F.max_by if k[0] == "b" else F.min_by
        place = F.when(F.col(m).isNotNull(), F.col(told[0]) if len(told) == 1 else F.struct(*told))
        if not isinstance(kinds[m], StructType):
            return pick(m, place)
        return F.when(F.count(m) > 0, F.struct(*[pick(F.col(m)[f], place).alias(f) for f in kinds[m].names]))

    ends = (rows if marked is None else ready(marked)).groupBy(RANGE).agg(*[end(k).alias(f"_e{of[k]}") for k in values])
    if marked is not None:
        ends = rows.select(RANGE).distinct().join(ends, RANGE, "left")

    def beyond(k: tuple[str, str]) -> Column:
        if k[0] == "b":
            return F.last(f"_e{of[k]}", True).over(_along().rowsBetween(Window.unboundedPreceding, -1))
        return F.expr(f"lead(`_e{of[k]}`) ignore nulls").over(_along())

    def local(k: tuple[str, str]) -> Column:
        if k[0] == "b":
            return F.last(mark[k], True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        # the next mark by lead(): a frame that ends unbounded is gone through anew for every row
        return F.coalesce(mark[k], F.expr(f"lead(`{mark[k]}`) ignore nulls").over(w))

    edges = ends.select(RANGE, *[beyond(k).alias(f"_c{of[k]}") for k in values])
    own = rows.withColumns({f"_l{of[k]}": local(k) for k in values}).join(edges, RANGE, "left")
    out = {n: F.coalesce(f"_l{of[side, n]}", f"_c{of[side, n]}") for side, n in values}
    return own.withColumns(out).drop(RANGE, *mark.values(), *[f"_{x}{of[k]}" for k in values for x in "lc"])


def previous(rows: DataFrame, order: list[str], at: Column, values: dict[str, Column], ahead: dict[str, Column] | None = None) -> DataFrame:
    """rows with, for each of values (new column -> value), that of the row before in the order of the columns `order`, and for each
    of ahead that of the row after."""
    sides = {"_p": (values, F.lag, F.max_by), "_n": (ahead or {}, F.lead, F.min_by)}
    sides = {c: x for c, x in sides.items() if x[0]}
    rows = by_range(rows, at).withColumns({f"_v{c}": F.struct(*[x.alias(n) for n, x in of.items()]) for c, (of, _, _) in sides.items()})
    # field by field, so that numbers are aggregated without a sort
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    ends = rows.groupBy(RANGE).agg(*[F.struct(*[pick(F.col(f"_v{c}")[n], place).alias(n) for n in of]).alias(f"_e{c}") for c, (of, _, pick) in sides.items()])
    edges = ends.select(RANGE, *[step(f"_e{c}").over(_along()).alias(f"_e{c}") for c, (_, step, _) in sides.items()])
    w = Window.partitionBy(RANGE).orderBy(*order)
    own = rows.withColumns({c: step(f"_v{c}").over(w) for c, (_, step, _) in sides.items()}).join(edges, RANGE, "left")
    got = {n: F.coalesce(c, f"_e{c}")[n] for c, (of, _, _) in sides.items() for n in of}
    return own.withColumns(got).drop(RANGE, *[f"{x}{c}" for c in sides for x in ("_v", "", "_e")])
