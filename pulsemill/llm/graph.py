"""Connected components on Spark by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    return (
        moved.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        .union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    )


def _print_of(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.shiftright(F.xxhash64("b", "a"), 24))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the undirected edges (a long, b long); root is the least node reachable.

    Each round rewires every node to the least neighbour it sees; a path of length n takes O(log n) rounds.
    Minima are partial aggregates and neighbours come by equi-joins, so that a hub's rows may be split.
    Loops, repeated edges and an empty table are fine; rows holding a null are ignored.
    """
    edges = edges.toDF("a", "b").where("a <> b")
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _print_of(now)
    while seen[0]:
        new = materialize(_small_star(_large_star(now).distinct()).distinct(), "edges")
        was, seen = seen, _print_of(new)
        discard(now)
        now = new
        if seen == was:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
