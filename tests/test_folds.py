"""Folds against plain loops, over batches of any size, on one long recording too."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsemill.operators import consensus, features, folds


def plain_thin(times, gap):
    out = []
    for t in sorted(set(times)):
        if not out or t - out[-1] > gap:
            out.append(t)
    return out


def plain_steady(xs, keep=10, least=3, most=20.0):
    kept = []
    for i, x in enumerate(xs):
        recent = [v for _, v in kept[-keep:]]
        if len(recent) < least or abs(x - sum(recent) / len(recent)) <= most:
            kept.append((i, x))
    return [i for i, _ in kept]


@pytest.fixture
def tiny_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, "3")
    yield
    spark.conf.set(key, was)


def test_thin(spark, tiny_batches):
    rng = random.Random(3)
    rows = [(rec, rng.randrange(0, 4000)) for rec in (1, 2, None) for _ in range(150)] + [(5, 10), (5, 10), (6, 0), (6, 200), (6, 201)]
    df = spark.createDataFrame(rows, "rec_id long, t_ms long").repartition(8)
    got = [(r.rec_id, r.t_ms) for r in consensus.thin(df, 20).collect()]
    want = [(rec, t) for rec in {r for r, _ in rows} for t in plain_thin([t for r, t in rows if r == rec], 20)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted(r.t_ms for r in consensus.thin(df.where("rec_id = 6"), 200).collect()) == [0, 201]
    assert consensus.thin(df.where("false"), 20).collect() == []


def test_delays(spark, tiny_batches):
    rng = random.Random(4)
    rows = [(rec, i, float(rng.choice([200, 205, 212, 240, 190]))) for rec in (1, 2) for i in range(60)] + [(3, 0, 100.0), (3, 1, 300.0), (3, 2, 100.0), (3, 3, 100.0)]
    df = spark.createDataFrame(rows, "rec_id long, i long, pat double").repartition(8)
    got = features.accepted_delays(df, ["i"]).collect()
    for rec in (1, 2, 3):
        assert sorted(r.i for r in got if r.rec_id == rec) == plain_steady([x for r, _, x in rows if r == rec])


def test_state_is_all_that_is_kept():
    """Five million beats of one recording, in batches: the fold holds no more than its last values."""
    decide = folds.apart(200)()
    rng = np.random.default_rng(0)
    at, kept, last = 0, 0, None
    for _ in range(500):
        times = at + np.cumsum(rng.integers(1, 400, 10_000))
        at = int(times[-1])
        kept += sum(decide(times.tolist()))
    assert 1_500_000 < kept < 5_000_000
    cells = dict(zip(decide.__code__.co_freevars, (c.cell_contents for c in decide.__closure__)))
    assert set(cells) == {"gap", "last"} and isinstance(cells["last"], int) and last is None
    steady = folds.steady()()
    steady([1.0] * 100_000)
    state = dict(zip(steady.__code__.co_freevars, (c.cell_contents for c in steady.__closure__)))
    assert len(state["recent"]) == 10


def test_nulls_are_one_key():
    batch = pa.RecordBatch.from_pydict({"a": [None, None, 1, 1, 2, None], "b": [1, 1, 1, 2, 2, 2]})
    assert folds._changes(batch, ["a", "b"]).tolist() == [False, False, True, True, True, True]


def test_no_recording_is_gathered(spark):
    df = spark.range(10).select(F.lit(1).cast("long").alias("rec_id"), (F.col("id") * 150).alias("t_ms"))
    plan = consensus.thin(df, 200)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "collect_set" not in plan
