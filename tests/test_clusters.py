"""Clusters of windows: equal on any partitions, numbered by their centres, the best of several starts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsemill.operators import clusters


def rows():
    rng = np.random.default_rng(4)
    centres = [(0, 0, 5), (10, 0, 5), (0, 12, 5), (9, 11, 5)]
    out = [(i, *map(float, rng.normal(c, 0.4)[:2]), 5.0) for i, c in enumerate(centres * 40)]
    return out, [i % 4 for i in range(160)]


@pytest.mark.parametrize("partitions", [1, 8])
def test_planted_clusters(spark, partitions):
    data, of = rows()
    df = spark.createDataFrame(data, "rec_id long, a double, b double, c double").repartition(partitions)
    got = {r.rec_id: r.cluster for r in clusters.kmeans(df, ["a", "b", "c"]).collect()}
    first = {k: got[k] for k in range(4)}
    assert sorted(first.values()) == [0, 1, 2, 3] and {first[0], first[2]} == {0, 1} and {first[1], first[3]} == {2, 3}
    assert all(got[i] == first[k] for i, k in enumerate(of))


def test_labels_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, *map(float, rng.normal(size=3))) for i in range(300)], "rec_id long, a double, b double, c double")
    one = {r.rec_id: r.cluster for r in clusters.kmeans(df.coalesce(1), ["a", "b", "c"]).collect()}
    many = {r.rec_id: r.cluster for r in clusters.kmeans(df.repartition(8), ["a", "b", "c"]).collect()}
    assert one == many and set(one.values()) == {0, 1, 2, 3}


def test_what_is_no_number_counts_as_nought(spark):
    data = [(1, float("nan"), 1.0), (2, float("inf"), 1.0), (3, None, 1.0), (4, 0.0, 1.0), (5, 6.0, 1.0)]
    x = {r.rec_id: r.x for r in clusters.standardised(spark.createDataFrame(data, "rec_id long, a double, b double"), ["a", "b"]).collect()}
    assert x[1] == x[2] == x[3] == x[4] and x[5][0] > 0 and x[5][1] == 0
    few = spark.createDataFrame(data[:3], "rec_id long, a double, b double")
    assert clusters.kmeans(few, ["a", "b"]).collect() == [] and clusters.kmeans(few.where(F.lit(False)), ["a"]).collect() == []
