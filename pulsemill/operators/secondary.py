"""Where beats are followed by waves of their own: the stretch of beats with the most secondary peaks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.filters import find_peaks
from . import joins, scan
from .folds import _changes
from .peaks import Skyline
from .windows import KEY, by

#: Where a secondary peak may lie after a beat and before the next one, in seconds, its least prominence as a share of
#: the stretch's largest sample, and the length of what stands for a recording without any.
AFTER, WITHIN, SHARE, DEFAULT_S = 0.2, 0.5, 0.05, 5.0


def zone_peaks(x: np.ndarray) -> list[tuple[int, float]]:
    """Place and prominence of the local maxima of a short signal."""
    sky, maxima = Skyline(), set(find_peaks(x).tolist()) if len(x) > 2 else set()
    found = [f for i, v in enumerate(x.tolist()) for f in sky.add(i, v, i in maxima)] + sky.end()
    return sorted((i, prominence) for i, _, prominence in found)


def intervals(signal: DataFrame, beats: DataFrame, fs: float, width: float = scan.RANGE_SAMPLES) -> DataFrame:
    """rec_id, beat, top, peaks for each of beats(rec_id, idx) of signal(rec_id, idx, v): the largest sample from the beat to the next one,
    and place and prominence of the local maxima in its zone, which goes from AFTER to WITHIN behind it and ends AFTER before the
    next one; the last beat has no zone. Maxima and prominences are those of a zone alone.

    Samples find their beat range by range, and an interval is worked on by itself; only its zone is held.
    """
    hold, reach = int(AFTER * fs), int(WITHIN * fs)
    until = F.least(F.col("idx") + reach, F.lead("idx").over(by("idx")) - hold)
    marks = beats.select(KEY, "idx", F.col("idx").alias("beat"), F.when(F.lead("idx").over(by("idx")).isNotNull(), until).alias("until"))
    held = joins.last_before(signal.select(KEY, "idx", F.col("v").cast("double").alias("v")), marks, {"beat": "beat", "until": "until"}, "idx", "idx", width=width).where("beat is not null")
    zone = (F.col("idx") >= F.col("beat") + hold) & (F.col("idx") < F.col("until"))
    rows = held.select(KEY, "beat", "idx", "v", F.coalesce(zone, F.lit(False)).alias("zone"))
    keys = [KEY, "beat"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the interval that goes on in the next batch: its keys, and its rows so far
        now, top, first, parts, done = None, -np.inf, 0, [], []

        def made(kind: pa.DataType) -> pa.RecordBatch:
            kinds = (kind, pa.int64(), pa.float64(), pa.list_(pa.struct([("idx", pa.int64()), ("prominence", pa.float64())])))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), kinds)], [*keys, "top", "peaks"])

        def ended() -> None:
            x = np.concatenate(parts) if parts else ()
            done.append((*now, top, [{"idx": first + i, "prominence": p} for i, p in zone_peaks(x)] if len(x) > 2 else []))

        kind = None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.schema.field(KEY).type
            v, inside = batch.column("v").to_numpy(zero_copy_only=False), batch.column("zone").to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero(_changes(batch, keys)), [batch.num_rows]])
            tops, zone = np.maximum.reduceat(v, cuts[:-1]).tolist(), np.flatnonzero(inside)
            lo, x, places = np.searchsorted(zone, cuts).tolist(), v[zone], batch.column("idx").to_numpy()[zone]
            for k, own in enumerate(zip(*(batch.column(c).take(pa.array(cuts[:-1])).to_pylist() for c in keys))):
                if own != now:
                    if now is not None:
                        ended()
                    now, top, parts = own, -np.inf, []
                top = max(top, tops[k])
                if lo[k] < lo[k + 1]:
                    if not parts:
                        first = int(places[lo[k]])
                    parts.append(x[lo[k] : lo[k + 1]])
            # a batch for a batch: one for each interval costs more than the interval
            if done:
                yield made(kind)
                done = []
        if now is not None:
            ended()
            yield made(kind)

    kind = signal.schema[KEY].dataType.simpleString()
    return rows.repartition(*keys).sortWithinPartitions(*keys, "idx").mapInArrow(run, f"{KEY} {kind}, beat long, top double, peaks array<struct<idx: long, prominence: double>>")


def prominent_stretch(signal: DataFrame, beats: DataFrame, fs: float, stretch: int = 5, lengths: DataFrame | None = None) -> DataFrame:
    """rec_id, start, end, n_secondary, first: of each recording the stretch of so many intervals between beats(rec_id, idx) in which, but
    for its last interval, the most secondary peaks stand out by SHARE of its largest sample, the earliest of equals; from its first
    beat to the one behind it, with their number and first place. A recording without any has its first DEFAULT_S seconds. lengths:
    rec_id and n, the last idx and one, where they are known without the signal's order."""
    order = by("beat")
    rows = intervals(signal, beats, fs).withColumns({
        "end": F.lead("beat", stretch).over(order),
        "bar": F.max("top").over(order.rowsBetween(0, stretch - 1)) * SHARE,
        "near": F.flatten(F.collect_list("peaks").over(order.rowsBetween(0, stretch - 2))),
    })
    found = rows.where("end is not null").withColumn("own", F.filter("near", lambda p: p["prominence"] >= F.col("bar"))).where(F.size("own") > 0)
    best = found.groupBy(KEY).agg(F.max_by(F.struct(F.col("beat").alias("start"), "end", F.size("own").cast("long").alias("n"), F.array_min("own.idx").alias("first")), F.struct(F.size("own").alias("n"), (-F.col("beat")).alias("early"))).alias("b"))
    length = signal.groupBy(KEY).agg((F.max("idx") + 1).alias("n")) if lengths is None else lengths.select(KEY, "n")
    none = {"start": F.lit(0).cast("long"), "end": F.least(F.lit(int(DEFAULT_S * fs)), "n").cast("long"), "n": F.lit(0).cast("long")}
    got = length.join(best, KEY, "left")
    pick = lambda c: F.coalesce(F.col(f"b.{c}"), none[c])
    return got.select(KEY, pick("start").alias("start"), pick("end").alias("end"), pick("n").alias("n_secondary"), F.col("b.first").alias("first"))
