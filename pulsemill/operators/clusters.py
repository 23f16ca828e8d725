"""K-means of windows by their features, the same whatever the partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import KEY

#: Rounds at most, and the largest move of a centre, squared, at which a start has settled.
ROUNDS, SETTLED = 100, 1e-10


def _clean(c: str) -> Column:
    """Nulls, NaN and infinities as 0."""
    x = F.col(c).cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def _features(rows: DataFrame, features: list[str], key: str) -> DataFrame:
    return rows.select(key, *[_clean(c).alias(c) for c in features])


def _kept(rows: DataFrame) -> DataFrame:
    """rows, worked out once: as a checkpoint where the session has a folder for them, or else on the executors."""
    if not rows.sparkSession.sparkContext.getCheckpointDir():
        return rows.localCheckpoint()
    held = rows.persist(StorageLevel.MEMORY_AND_DISK)  # a checkpoint reads its rows twice
    try:
        return rows.checkpoint()
    finally:
        held.unpersist()


def standardised(rows: DataFrame, features: list[str], key: str = KEY) -> DataFrame:
    """key, x: the array of the features, each less its mean and over its standard deviation, the population's; one that does not
    vary is only moved."""
    clean = _features(rows, features, key)
    m = clean.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = [(F.col(c) - (m[f"m{i}"] or 0.0)) / (m[f"s{i}"] or 1.0) for i, c in enumerate(features)]
    return clean.select(key, F.array(*scaled).alias("x"))


def _first_centres(x: DataFrame, k: int, starts: int, seed: int, key: str) -> np.ndarray | None:
    """For each start k rows, each the least by a hash in its share of the rows; None with fewer rows."""
    of = lambda s: F.xxhash64(F.lit(seed + s), F.col(key))
    pick = [F.min(F.when(F.pmod(of(s), F.lit(k)) == j, F.struct(of(s).alias("h"), "x"))).alias(f"c{s}_{j}") for s in range(starts) for j in range(k)]
    row = x.agg(F.count("*").alias("n"), *pick).first()
    if row["n"] < k:
        return None
    some = next(r["x"] for r in (row[f"c{s}_{j}"] for s in range(starts) for j in range(k)) if r)
    return np.array([[(row[f"c{s}_{j}"] or {"x": some})["x"] for j in range(k)] for s in range(starts)])


def _sums(centres: np.ndarray):
    """start, cluster, n, cost and sums of the rows nearest to each centre, for all starts in one pass."""
    starts, k, d = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, cost, total = np.zeros((starts, k)), np.zeros((starts, k)), np.zeros((starts, k, d))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy().reshape(-1, d)
            for s in range(starts):
                far = ((x[:, None, :] - centres[s]) ** 2).sum(axis=2)
                near = far.argmin(axis=1)
                n[s] += np.bincount(near, minlength=k)
                cost[s] += np.bincount(near, far.min(axis=1), k)
                np.add.at(total[s], near, x)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (n, cost, total)], ["n", "cost", "total"])

    return run


def kmeans(rows: DataFrame, features: list[str], k: int = 4, starts: int = 10, seed: int = 42, key: str = KEY) -> DataFrame:
    """key, cluster (from 0): rows in k clusters of their standardised features, of `starts` starts the one of the least cost. Clusters are
    numbered in the order of their centres, so that numbers can be compared between runs. Fewer rows than k give no rows.

    The features are worked out once, for their means, the rounds and the result. Starts are chosen by hashes of the key; a round is one pass for all starts, whose sums are a few numbers from each partition.
    """
    x = standardised(_kept(_features(rows, features, key)), features, key)
    held = x.persist(StorageLevel.MEMORY_AND_DISK)  # for the rounds alone
    try:
        best = _best_centres(held, len(features), k, starts, seed, key)
    finally:
        held.unpersist()
    if best is None:
        return x.select(key, F.lit(0).alias("cluster")).limit(0)
    far = [sum(((F.col("x")[i] - float(c)) * (F.col("x")[i] - float(c)) for i, c in enumerate(centre)), F.lit(0.0)) for centre in best]
    return x.select(key, (F.array_position(F.array(*far), F.array_min(F.array(*far))) - 1).cast("int").alias("cluster"))


def _best_centres(x: DataFrame, d: int, k: int, starts: int, seed: int, key: str) -> np.ndarray | None:
    centres = _first_centres(x, k, starts, seed, key)
    if centres is None:
        return None
    cost = None
    for _ in range(ROUNDS):
        parts = x.select("x").mapInArrow(_sums(centres), "n binary, cost binary, total binary").collect()
        add = lambda c: sum(np.frombuffer(p[c]) for p in parts)  # noqa: E731, B023
        n, cost, total = add("n").reshape(starts, k, 1), add("cost").reshape(starts, k).sum(axis=1), add("total").reshape(starts, k, d)
        moved = np.where(n > 0, total / np.maximum(n, 1), centres)
        settled = ((moved - centres) ** 2).sum(axis=2).max() <= SETTLED
        centres = moved
        if settled:
            break
    best = centres[int(np.round(cost, 6).argmin())]
    return best[np.lexsort(np.round(best, 6).T[::-1])]
