"""Quantiles by counts and ranges equal percentile(), bit by bit."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pulsemill.operators import selection

PROBS = [0.0, 0.005, 0.25, 0.5, 0.9, 0.995, 1.0]


def rows():
    rng = random.Random(7)
    data = {"even": [float(i) for i in range(100)], "skew": [math.exp(rng.gauss(0, 8)) for _ in range(999)], "ties": [float(rng.randrange(3)) for _ in range(500)], "one": [4.5], "two": [1.0, 2.0], "outlier": [1e300] + [rng.random() for _ in range(300)], "minus": [-rng.random() for _ in range(64)] + [None, None], "same": [7.0] * 50}
    return [(r, v) for r, x in data.items() for v in x] + [("none", None)]


@pytest.mark.parametrize("ranges", [1, 5, 64])
def test_equals_percentile(spark, ranges):
    df = spark.createDataFrame(rows(), "rec_id string, v double").repartition(8)
    want = {r.rec_id: list(r.q) for r in df.where("v is not null").groupBy("rec_id").agg(F.percentile("v", F.array(*map(F.lit, PROBS))).alias("q")).collect()}
    got = {r.rec_id: list(r.q) for r in selection.quantiles(df, PROBS, ranges=ranges).collect()}
    assert got == want and "none" not in got


def test_no_buffer_of_values(spark):
    df = spark.createDataFrame(rows(), "rec_id string, v double")
    plan = selection.median(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_" not in plan and "percentile(" not in plan
    got = {r.rec_id: r.median for r in selection.median(df).collect()}
    assert got["even"] == 49.5 and got["two"] == 1.5 and got["same"] == 7.0
    assert selection.median(df.where("false")).collect() == []


def test_large_groups_have_the_same_cuts_in_both_branches(spark):
    rng = random.Random(11)
    df = spark.createDataFrame([(r, round(rng.uniform(0, 1e5), 2)) for r in range(3) for _ in range(30_000)], "rec_id long, v double").repartition(16)
    want = {r.rec_id: list(r.q) for r in df.groupBy("rec_id").agg(F.percentile("v", F.array(*map(F.lit, PROBS))).alias("q")).collect()}
    for _ in range(3):
        assert {r.rec_id: list(r.q) for r in selection.quantiles(df, PROBS).collect()} == want
    # no sketch that depends on the order of merging: each group's cuts come from values picked by their hash
    plan = selection.quantiles(df, PROBS)._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(_v" in plan
