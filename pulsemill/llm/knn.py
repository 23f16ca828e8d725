"""Exact top-k inner-product search as a Voronoi join.

Vectors are grouped by their nearest pivot. For a query q and a vector x of the group of pivot p,
|<q, x> - <q, p>| <= |q| |x - p|. The summary of each group, its largest distance to the pivot, its largest norm and
its k + 1 least distances, thus bounds each query's k-th score from below and every group's scores from above; a
query is replicated only to the groups that can reach its k-th score, and solved there.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Least and most pivots; in between there are as many as the root of the number of vectors, so that groups and their number
#: grow alike.
PIVOTS, MOST = 64, 4096
#: Rows of a group, and queries, that one task solves at once; more are dealt into blocks.
BLOCK, QUERIES = 8192, 2048
#: Numbers of a table of rows by pivots, or by bounds, that a task holds at once.
HELD = 1 << 21


def quantized(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, v: floor(scale * x) of every component, without the rows that take no part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray, dims: int = 0) -> np.ndarray:
    """Rows of a list column; shorter ones are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    dims = max(dims, int(sizes.max(initial=0)))
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a and b, exact while they fit in a long."""
    dims = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (a, b))
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * dims
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _slices(rows: int, width: int) -> list[tuple[int, int]]:
    """Bounds of consecutive rows whose tables of so many columns hold about HELD numbers."""
    step = max(1, HELD // max(1, width))
    return [(a, min(rows, a + step)) for a in range(0, rows, step)]


def _assign(pivots: np.ndarray):
    p = pivots.astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("v"), p.shape[1]).astype(np.float64)
                q = np.pad(p, ((0, 0), (0, x.shape[1] - p.shape[1])))
                size = (q * q).sum(axis=1)
                g = np.concatenate([(size - 2 * (x[a:b] @ q.T)).argmin(axis=1) for a, b in _slices(len(x), len(q))])
                dist = np.sqrt(((x - q[g]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(g.astype(np.int64)), pa.array(dist), pa.array(np.sqrt((x * x).sum(axis=1)))], ["vec_id", "v", "g", "dist", "norm"])

    return run


def _route(pivots: np.ndarray, groups: list[int], radius: np.ndarray, norms: np.ndarray, near_group: np.ndarray, near_dist: np.ndarray, k: int):
    p = pivots.astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v"), p.shape[1]).astype(np.float64)
            q = np.pad(p, ((0, 0), (0, x.shape[1] - p.shape[1])))
            for a, b in _slices(len(x), max(len(q), len(near_group))):
                size = np.sqrt((x[a:b] * x[a:b]).sum(axis=1))[:, None]
                to = x[a:b] @ q.T
                slack = 1e-6 * (1 + np.abs(to).max())
                most = np.minimum(to[:, groups] + size * radius, size * norms) + slack
                least = to[:, near_group] - size * near_dist - slack
                # the query itself may be one of the vectors behind these bounds, hence k + 1
                bar = np.partition(least, -(k + 1), axis=1)[:, -(k + 1)] if least.shape[1] > k else np.full(b - a, -np.inf)
                row, col = np.nonzero(most >= bar[:, None])
                at = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("v").take(at), pa.array(np.array(groups, np.int64)[col])], ["vec_id", "v", "g"])

    return run


def _solve(k: int):
    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        empty = pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        if not queries.num_rows or not data.num_rows:
            return empty
        data = data.sort_by("vec_id")
        ids, asked = data.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
        q, x = matrix(queries.column("v")), matrix(data.column("v"))
        out = []
        step = max(1, (1 << 21) // len(ids))
        for at in range(0, len(asked), step):
            scores = products(q[at : at + step], x)
            for i, row in zip(asked[at : at + step], scores):
                fit = np.flatnonzero(ids != i)
                if len(fit) > k:
                    bar = np.partition(row[fit], len(fit) - k)[len(fit) - k]
                    fit = fit[row[fit] >= bar]
                best = fit[np.argsort(-row[fit], kind="stable")][:k]
                out.append((np.full(len(best), i), ids[best], row[best]))
        return pa.table({c: pa.array(np.concatenate(x)) for c, x in zip(("query_id", "vec_id", "score"), zip(*out))}) if out else empty

    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, pivots: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of vectors(vec_id, embedding) whose vec_id is divisible
    by `every`, the k rows of other vec_id with the largest integer inner product; ties go to the smaller vec_id.

    Vectors that are null or hold a null or non-finite component, and rows without a vec_id, take no part. A shorter
    vector counts as filled up with zeros. Rows that repeat a vec_id with the same vector are one; fewer than k
    candidates give fewer rows; an empty table gives an empty one; other columns are not read. The pivots, the
    groups' summaries and counts are all that reaches the driver: pivots * (k + 1) numbers.
    """
    rows = materialize(quantized(vectors, scale).distinct(), "voronoi-vectors")
    pivots = pivots or max(PIVOTS, min(MOST, isqrt(rows.count())))
    chosen = rows.orderBy(F.xxhash64("v"), "vec_id").limit(pivots).select("v").distinct().collect()
    result = "query_id long, vec_id long, score long"
    if not chosen:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.col("vec_id").alias("score")).limit(0)
    dims = max(len(r.v) for r in chosen)
    pivot = np.array([list(r.v) + [0] * (dims - len(r.v)) for r in chosen], np.int64)
    placed = materialize(rows.mapInArrow(_assign(pivot), "vec_id long, v array<long>, g long, dist double, norm double"), "voronoi")

    stats = placed.groupBy("g").agg(F.count("*").alias("n"), F.max("dist").alias("r"), F.max("norm").alias("norm")).orderBy("g").collect()
    nearest = Window.partitionBy("g").orderBy("dist", "vec_id")
    near = placed.select("g", "dist", "vec_id").withColumn("i", F.row_number().over(nearest)).where(F.col("i") <= k + 1).select("g", "dist").collect()
    route = _route(pivot, [s.g for s in stats], np.array([s.r for s in stats]), np.array([s.norm for s in stats]), np.array([x.g for x in near]), np.array([x.dist for x in near]), k)
    queries = materialize(placed.where(F.col("vec_id") % every == 0).select("vec_id", "v").mapInArrow(route, "vec_id long, v array<long>, g long"), "voronoi-queries")
    asked = {r.g: ceil(r.n / QUERIES) for r in queries.groupBy("g").agg(F.count("*").alias("n")).collect()}

    # a row for each group, of which there are MOST at most; groups that no query is sent to are left out
    numbers = [(s.g, ceil(s.n / BLOCK), asked[s.g]) for s in stats if s.g in asked]
    counts = F.broadcast(placed.sparkSession.createDataFrame(numbers, "g long, n_data long, n_asked long"))
    every_block = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n))
    left = queries.join(counts, "g").withColumn("d", every_block("n_data")).withColumn("q", mine("n_asked")).select("g", "d", "q", "vec_id", "v")
    right = placed.join(counts, "g").withColumn("d", mine("n_data")).withColumn("q", every_block("n_asked")).select("g", "d", "q", "vec_id", "v")
    keys = ["g", "d", "q"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_solve(k), result)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
