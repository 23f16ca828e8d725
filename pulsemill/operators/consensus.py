"""Consensus of several beat detectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import folds
from .peaks import find_peaks, middles, spaced
from .spectral import KEY, PANE, density_panes, own_places
from .windows import by


def density(peaks: DataFrame, weights: DataFrame | None, sigma: float, missing: float = 0.5, lengths: DataFrame | None = None) -> DataFrame:
    """rec_id, t, density (of the recording's maximum) for peaks(rec_id, detector, t), of which those of one detector at one place
    count once; weights(detector, weight) are shared out to a sum of one, a detector without one counting as `missing`.
    lengths: as in gaussian_density()."""
    return own_places(_panes(peaks, weights, sigma, missing, lengths)).select(KEY, "t", (F.col("density") / F.col("top")).alias("density"))


def _panes(peaks: DataFrame, weights: DataFrame | None, sigma: float, missing: float, lengths: DataFrame | None) -> DataFrame:
    """density_panes() with top, the recording's maximum."""
    peaks = peaks.select(KEY, "detector", "t").distinct()
    if weights is None:
        weighted = peaks.withColumn("w", F.lit(1.0))
    else:
        own = peaks.select("detector").distinct().join(weights, "detector", "left").withColumn("weight", F.coalesce("weight", F.lit(missing)))
        total = own.agg((F.sum("weight") + 1e-9).alias("total"))
        share = own.join(F.broadcast(total)).select("detector", (F.col("weight") / F.col("total")).alias("w"))  # one row for each detector
        weighted = peaks.join(share, "detector")
    d = density_panes(weighted.where("w > 0"), sigma, lengths=lengths)
    top = d.select(KEY, F.array_max(F.slice("d", 2, PANE)).alias("top")).groupBy(KEY).agg(F.max("top").alias("top"))
    return d.join(top, KEY)


def agreed(peaks: DataFrame, weights: DataFrame | None, sigma: float, lengths: DataFrame, height: float = 0.4, distance: int = 15, digits: int = 9, missing: float = 0.5) -> DataFrame:
    """consensus_peaks() of the density(): what may be a peak is told within panes, so that no recording's density is sorted."""
    panes = _panes(peaks, weights, sigma, missing, lengths).select(KEY, "n", "pane", "d", "top")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, pane, top = (batch.column(c).to_numpy()[:, None] for c in ("n", "pane", "top"))
            d = batch.column("d").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, PANE + 2)
            place = pane * PANE + np.arange(PANE)
            x = np.round(d / top, digits)
            v = x[:, 1:-1]
            # a place that no peak reaches is zero, one outside of the recording no neighbour
            x = np.where(np.isnan(x), 0.0, x)
            before, after = np.where(place > 0, x[:, :-2], np.nan), np.where(place < n - 1, x[:, 2:], np.nan)
            rises, falls, begins, ends = before < v, after < v, before != v, after != v
            row, i = np.nonzero((v >= height) & ((begins & ends & rises & falls) | (begins != ends)))
            if len(row):
                flags = [pa.array(f[row, i]) for f in (rises, falls, begins, ends)]
                yield pa.RecordBatch.from_arrays([batch.column(KEY).take(pa.array(row)), pa.array(place[row, i]), pa.array(v[row, i]), *flags], [KEY, "_at", "_v", "_rises", "_falls", "_begins", "_ends"])

    kind = panes.schema[KEY].dataType.simpleString()
    few = panes.mapInArrow(run, f"{KEY} {kind}, _at long, _v double, _rises boolean, _falls boolean, _begins boolean, _ends boolean")
    return spaced(middles(few, "t", "density"), distance, "t", "density")


def consensus_peaks(density: DataFrame, lengths: DataFrame, height: float = 0.4, distance: int = 15, digits: int = 9) -> DataFrame:
    """rec_id, t, density of the peaks of density(rec_id, t, density) of at least a height, at least a distance apart, the highest
    staying. Places without a row have none; a peak at either end of a recording is none. Densities are compared to so many
    digits, so that sums in another order have the same peaks."""
    d = density.select(KEY, "t", F.round("density", digits).alias("density"))
    return find_peaks(d, height, distance, "t", "density", missing=0.0, lengths=lengths)


def thin(peaks: DataFrame, gap: int) -> DataFrame:
    """rec_id, t_ms: of each recording's distinct peaks those more than `gap` after the last one kept.

    A peak more than `gap` after the one before it is kept whatever was kept earlier, so a recording falls into runs of closer
    peaks; each run is folded by itself, with the last kept time as its state.
    """
    w = by("t_ms")
    times = peaks.select(KEY, "t_ms").distinct()
    runs = times.withColumn("_far", F.coalesce(F.col("t_ms") - F.lag("t_ms").over(w) > gap, F.lit(True)).cast("long")).withColumn("_run", F.sum("_far").over(w)).drop("_far")
    return folds.fold(runs, [KEY, "_run"], ["t_ms"], "t_ms", folds.apart(gap)).drop("_run")
