"""Peaks of long signals: plateaus told as runs, and peaks too close to higher ones suppressed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .folds import _changes
from .windows import KEY, by


def local_maxima(signal: DataFrame, at: str = "idx", v: str = "v", width: float = scan.RANGE_SAMPLES, missing: float | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """rec_id, at, v: the middle places (the left one of two) of runs of equal values that lie over the values before and behind
    them. A place without a row, or with null or NaN, counts as `missing`, or else is no neighbour; with lengths(rec_id, n) places
    before 0 and from n on are no neighbours.

    Samples are looked at range by range; of what may be a peak, and of the ends of longer runs, a recording is one sort.
    """
    rows = signal.where(F.col(v).isNotNull() & ~F.isnan(v)).select(KEY, F.col(at).alias("_at"), F.col(v).alias("_v"))
    rows = scan.previous(rows, ["_at"], scan.every("_at", width), {"_pat": F.col("_at"), "_pv": F.col("_v")}, {"_nat": F.col("_at"), "_nv": F.col("_v")})
    rows = rows.join(lengths.select(KEY, "n"), KEY) if lengths is not None else rows.withColumn("n", F.lit(None).cast("long"))
    gap = F.lit(missing).cast("double")
    before = F.when(F.col("_pat") == F.col("_at") - 1, F.col("_pv")).when(F.col("n").isNull() | (F.col("_at") > 0), gap)
    after = F.when(F.col("_nat") == F.col("_at") + 1, F.col("_nv")).when(F.col("n").isNull() | (F.col("_at") < F.col("n") - 1), gap)
    sure = lambda c: F.coalesce(c, F.lit(False))
    rows = rows.withColumns({"_b": before, "_a": after})
    rows = rows.select(KEY, "_at", "_v", sure(F.col("_b") < F.col("_v")).alias("_rises"), sure(F.col("_a") < F.col("_v")).alias("_falls"), (~sure(F.col("_b") == F.col("_v"))).alias("_begins"), (~sure(F.col("_a") == F.col("_v"))).alias("_ends"))
    return middles(rows.where("(_begins and _ends and _rises and _falls) or _begins <> _ends"), at, v)


def middles(few: DataFrame, at: str, v: str) -> DataFrame:
    """rec_id, at, v: the middle places of the runs that rise before and fall behind, of few(rec_id, _at, _v, _rises, _falls, _begins,
    _ends), the ends of runs of several and the peaks of one place."""
    # where a run of several begins the row of its end is the next one
    w = by("_at")
    start = F.when(F.col("_begins"), F.struct(F.col("_at").alias("at"), F.col("_rises").alias("rises"))).otherwise(F.struct(F.lag("_at").over(w).alias("at"), F.lag("_rises").over(w).alias("rises")))
    found = few.withColumn("_from", start).where("_ends and _falls and _from.rises")
    return found.select(KEY, F.floor((F.col("_from.at") + F.col("_at")) / 2).alias(at), F.col("_v").alias(v))


def highest_first(places: np.ndarray, heights: np.ndarray, distance: int) -> np.ndarray:
    """Which of the peaks, in order of place, stay if, from the highest down, each that stays removes those less than `distance` away;
    of equally high ones the later goes first."""
    lo, hi = np.searchsorted(places, places - distance, "right").tolist(), np.searchsorted(places, places + distance, "left").tolist()
    stays = bytearray(b"\1" * len(places))
    for i in np.argsort(heights, kind="stable")[::-1].tolist():
        if stays[i]:
            stays[lo[i] : hi[i]] = bytes(hi[i] - lo[i])
            stays[i] = 1
    return np.frombuffer(stays, bool)


def spaced(peaks: DataFrame, distance: int, at: str = "idx", v: str = "v") -> DataFrame:
    """The rows of peaks(rec_id, at, v) that stay under highest_first(). Peaks fall into islands, within which neighbours are less than
    `distance` apart; an island is settled by itself."""
    w = by(at)
    rows = peaks.select(KEY, at, v).withColumn("_far", F.coalesce(F.col(at) - F.lag(at).over(w) >= distance, F.lit(True)).cast("long"))
    rows = rows.withColumn("_island", F.sum("_far").over(w)).drop("_far")
    keys = [KEY, "_island"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def solved() -> pa.Table:
            island = pa.Table.from_batches(held).combine_chunks()
            stays = highest_first(island[at].to_numpy(), island[v].to_numpy(), distance)
            return island.filter(pa.array(stays))

        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = [0, *np.flatnonzero(_changes(batch, keys)).tolist(), batch.num_rows]
            out = []
            for a, b in zip(cuts, cuts[1:]):
                own = tuple(batch.column(c)[a].as_py() for c in keys)
                if held and own != now:
                    out.append(solved())
                    held = []
                now = own
                held.append(batch.slice(a, b - a))
            if out:
                yield from pa.concat_tables(out).combine_chunks().to_batches()
        if held:
            yield from solved().to_batches()

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, at)
    return dealt.mapInArrow(run, rows.schema).drop("_island")


class Skyline:
    """The values that no later one has passed, each with what is needed to tell its prominence once one passes it: the least value on
    its left as far as the next higher one, the least one since the value below it on the stack, and the least one behind it."""

    def __init__(self) -> None:
        self.stack: list[list] = []

    def add(self, at: int, x: float, peak: bool) -> list[tuple[int, float, float]]:
        """(at, x, prominence) of the peaks that x is higher than."""
        found, span = [], x
        while self.stack and self.stack[-1][1] < x:
            span = min(span, self._pop(found))
        top = self.stack[-1] if self.stack else None
        left = min(span, top[2], top[4]) if top and top[1] == x else span
        self.stack.append([at, x, left, span, x, peak])
        return found

    def _pop(self, found: list) -> float:
        at, x, left, span, behind, peak = self.stack.pop()
        if peak:
            found.append((at, x, x - max(left, behind)))
        span = min(span, behind)
        if self.stack:
            self.stack[-1][4] = min(self.stack[-1][4], span)
        return span

    def end(self) -> list[tuple[int, float, float]]:
        found: list[tuple[int, float, float]] = []
        while self.stack:
            self._pop(found)
        return found


def prominences(signal: DataFrame, peaks: DataFrame, at: str = "idx", v: str = "v") -> DataFrame:
    """rec_id, at, v, prominence of peaks(rec_id, at) of signal(rec_id, at, v): the height over the higher of the least values on either
    side, as far as the next higher sample. A recording streams through one task, which holds its skyline."""
    valid = signal.where(F.col(v).isNotNull() & ~F.isnan(v)).select(KEY, F.col(at).cast("long").alias("_at"), F.col(v).cast("double").alias("_v"))
    rows = valid.join(peaks.select(KEY, F.col(at).cast("long").alias("_at"), F.lit(True).alias("_peak")), [KEY, "_at"], "left").withColumn("_peak", F.coalesce("_peak", F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sky, kind = None, Skyline(), None
        for batch in batches:
            kind, out = batch.schema.field(KEY).type, []
            for rec, place, x, peak in zip(*(batch.column(c).to_pylist() for c in (KEY, "_at", "_v", "_peak"))):
                if rec != now:
                    out += [(now, *f) for f in sky.end()]
                    now, sky = rec, Skyline()
                out += [(rec, *f) for f in sky.add(place, x, peak)]
            if out:
                yield made(out, kind)
        if last := [(now, *f) for f in sky.end()]:
            yield made(last, kind)

    def made(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (kind, pa.int64(), pa.float64(), pa.float64()))], [KEY, at, v, "prominence"])

    kind = signal.schema[KEY].dataType.simpleString()
    return rows.repartition(KEY).sortWithinPartitions(KEY, "_at").mapInArrow(run, f"{KEY} {kind}, `{at}` long, `{v}` double, prominence double")


def find_peaks(signal: DataFrame, height: float | None = None, distance: int | None = None, at: str = "idx", v: str = "v", **gaps) -> DataFrame:
    """rec_id, at, v of the local_maxima() of at least a height that are at least a distance apart, the highest staying."""
    found = local_maxima(signal, at, v, **gaps)
    if height is not None:
        found = found.where(F.col(v) >= height)
    return spaced(found, distance, at, v) if distance and distance > 1 else found
