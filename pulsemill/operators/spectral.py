"""Spectra, correlation by lag and smoothing, as sums that Catalyst can run."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "rec_id"
#: Places of a pane of a density, and panes that a task works on at once.
PANE, PANES = 256, 512


def hann(n: int) -> list[float]:
    from math import cos

    return [0.5 - 0.5 * cos(2 * pi * i / n) for i in range(n)]


def welch(frames: DataFrame, n: int, fs: float, segment: int) -> DataFrame:
    """rec_id, f, power: density by Welch's method for frames(rec_id, x) of n samples: Hann segments that overlap by half,
    each less its mean. The transform is a sum over a segment's samples for every frequency, inside one row's arrays."""
    half = segment // 2
    window = hann(segment)
    scale = 1.0 / (fs * sum(w * w for w in window))
    starts = F.array(*[F.lit(s) for s in range(0, n - segment + 1, half)])
    w = F.array(*[F.lit(x) for x in window])

    def part(s: Column) -> Column:
        seg = F.slice("x", s + 1, segment)
        mean = F.aggregate(seg, F.lit(0.0), lambda a, v: a + v) / segment
        return F.zip_with(F.transform(seg, lambda v: v - mean), w, lambda a, b: a * b)

    rows = frames.select(KEY, F.explode(F.transform(starts, part)).alias("y")).select(KEY, "y", F.explode(F.array(*[F.lit(k) for k in range(half + 1)])).alias("k"))
    angle = lambda i: i * F.col("k") * (2 * pi / segment)
    total = lambda g: F.aggregate(F.transform("y", lambda v, i: v * g(angle(i))), F.lit(0.0), lambda a, v: a + v)
    re, im = total(F.cos), total(F.sin)
    side = F.when((F.col("k") == 0) | (F.col("k") == half), 1.0).otherwise(2.0)
    rows = rows.select(KEY, "k", (side * scale * (re * re + im * im)).alias("p"))
    return rows.groupBy(KEY, "k").agg(F.avg("p").alias("power")).select(KEY, (F.col("k") * (fs / segment)).alias("f"), "power")


def band_power(spectrum: DataFrame, bands: dict[str, Column]) -> DataFrame:
    """rec_id and a column for each band, a condition on f: the trapezoids between neighbouring frequencies of the band."""
    from pyspark.sql import Window

    w = Window.partitionBy(KEY).orderBy("f")
    out = spectrum
    for name, inside in bands.items():
        own = F.when(inside, F.struct("f", "power"))
        before = F.last(own, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        out = out.withColumn(f"_{name}", F.when(inside & before.isNotNull(), (F.col("power") + before["power"]) / 2 * (F.col("f") - before["f"])))
    return out.groupBy(KEY).agg(*[F.coalesce(F.sum(f"_{n}"), F.lit(0.0)).alias(n) for n in bands])


def xcorr(pairs: DataFrame, n: int, max_lag: int, method: str = "squared") -> DataFrame:
    """rec_id, lag, r for pairs(rec_id, a, b) of arrays of n samples: correlation of b with a moved by each lag, with the
    mean removed before and after the transform, over the root of both energies. squared does not see polarity; whole
    correlates the samples as they are, over both standard deviations."""

    def centred(x: Column) -> Column:
        mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
        return F.transform(x, lambda v: v - mean)

    def ready(x: Column) -> Column:
        if method == "whole":
            return x
        x = centred(x)
        return centred(F.transform(x, lambda v: v * v)) if method == "squared" else x

    energy = lambda x: F.aggregate(F.col(x), F.lit(0.0), lambda s, v: s + v * v)
    rows = pairs.select(KEY, ready(F.col("a")).alias("a"), ready(F.col("b")).alias("b"))
    if method == "whole":
        spread = lambda x: F.aggregate(centred(F.col(x)), F.lit(0.0), lambda s, v: s + v * v)
        norm = F.sqrt(spread("a") * spread("b")) + 1e-9
    else:
        norm = F.sqrt(energy("a") * energy("b")) + 1e-12
    rows = rows.withColumn("e", norm).withColumn("lag", F.explode(F.array(*[F.lit(k) for k in range(-max_lag, max_lag + 1)])))
    # b[i + lag] against a[i]
    x = F.slice("a", F.greatest(F.lit(0), -F.col("lag")) + 1, n - F.abs("lag"))
    y = F.slice("b", F.greatest(F.lit(0), F.col("lag")) + 1, n - F.abs("lag"))
    r = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return rows.select(KEY, "lag", (r / F.col("e")).alias("r"))


def density_panes(peaks: DataFrame, sigma: float, weight: str = "w", lengths: DataFrame | None = None) -> DataFrame:
    """rec_id, n, pane, d: the gaussian_density() at the PANE places of a pane and at one more on either side, d[0] being that at
    pane * PANE - 1; null where no peak reaches, and outside of 0 to n - 1 if there are lengths.

    What is shuffled is a row for each peak, or two at the borders of panes, not one for each place that it reaches.
    """
    reach = int(4 * sigma + 0.5)
    gauss = [exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    total, wide, bounded = sum(gauss), PANE + 2, lengths is not None
    t = F.col("t")
    rows = peaks.groupBy(KEY, "t").agg(F.sum(weight).alias("_w"))
    images = F.array(t.cast("long"))
    if lengths is None:
        rows = rows.withColumn("n", F.lit(None).cast("long"))
    else:
        rows = rows.join(lengths.select(KEY, F.col("n").cast("long").alias("n")), KEY).where("t >= 0 and t < n")
        period = 2 * F.col("n")
        reps = F.ceil(F.lit(reach) / period)
        turns = F.sequence(-reps, reps)
        mirrored = F.concat(F.transform(turns, lambda j: t + j * period), F.transform(turns, lambda j: -1 - t + j * period))
        near = F.filter(mirrored, lambda a: (a >= -reach) & (a < F.col("n") + reach))
        images = F.when((t >= reach) & (t < F.col("n") - reach), F.array(t.cast("long"))).otherwise(near)
    rows = rows.select(KEY, "n", "_w", F.explode(images).alias("_y"))
    first, last = F.ceil((F.col("_y") - PANE - reach) / PANE), F.floor((F.col("_y") + reach + 1) / PANE)
    if bounded:
        first, last = F.greatest(first, F.lit(0).cast("long")), F.least(last, F.floor((F.col("n") - 1) / PANE))
    rows = rows.withColumns({"_first": first, "_last": last}).where("_first <= _last")
    rows = rows.withColumn("pane", F.explode(F.sequence("_first", "_last")))
    panes = rows.groupBy(KEY, "n", "pane").agg(F.collect_list(F.struct(F.col("_y").cast("long").alias("y"), F.col("_w").cast("double").alias("w"))).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PANES):
                batch = whole.slice(at, PANES)
                m, s, pane = batch.num_rows, batch.column("s"), batch.column("pane").to_numpy()
                of = np.repeat(np.arange(m), s.value_lengths().to_numpy())
                y, w = (s.flatten().field(i).to_numpy() for i in (0, 1))
                held, there = np.zeros((m, wide + 2 * reach)), np.zeros((m, wide + 2 * reach), bool)
                put = of, y - pane[of] * PANE + 1 + reach
                held[put], there[put] = w, True
                d, reached = np.zeros((m, wide)), np.zeros((m, wide), bool)
                for k, g in enumerate(gauss):
                    d += held[:, k : k + wide] * g
                    reached |= there[:, k : k + wide]
                if bounded:
                    place = pane[:, None] * PANE + np.arange(-1, PANE + 1)
                    reached &= (place >= 0) & (place < batch.column("n").to_numpy()[:, None])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * wide, pa.int32()), pa.array((d / total).ravel(), mask=~reached.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(KEY), batch.column("n"), batch.column("pane"), lists], [KEY, "n", "pane", "d"])

    return panes.mapInArrow(run, f"{KEY} {peaks.schema[KEY].dataType.simpleString()}, n long, pane long, d array<double>")


def own_places(panes: DataFrame) -> DataFrame:
    """rec_id, t, density and what else panes has beside n, pane and d: a row for each place of a pane that a peak reaches."""
    more = [c for c in panes.columns if c not in (KEY, "n", "pane", "d")]
    rows = panes.select(KEY, "pane", *more, F.posexplode(F.slice("d", 2, PANE)).alias("_i", "density")).where("density is not null")
    return rows.select(KEY, (F.col("pane") * PANE + F.col("_i")).alias("t"), "density", *more)


def gaussian_density(peaks: DataFrame, sigma: float, weight: str = "w", lengths: DataFrame | None = None) -> DataFrame:
    """rec_id, t, density at whole times around peaks(rec_id, t, w): spikes smoothed by a Gaussian cut at four sigma. With lengths(rec_id,
    n) what reaches beyond place 0 or n - 1 is reflected there (c b a | a b c), and peaks beyond are no peaks."""
    return own_places(density_panes(peaks, sigma, weight, lengths)).select(KEY, "t", "density")
