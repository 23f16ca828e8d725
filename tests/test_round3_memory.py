"""What tasks hold and how often rows are worked out, where it once grew with the input."""

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pulsemill.llm import common, suffixes, superkmers
from pulsemill.operators import clusters, detectors, noise, scan, secondary
from pulsemill.plans import QUERIES, bindings
from test_round3 import both


def test_features_of_clusters_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def feature(i):
        seen.add(1)
        return float(i % 4 * 100 + i % 3)

    df = spark.range(60).select(F.col("id").alias("rec_id"), feature("id").alias("a"))
    assert clusters.kmeans(df, ["a"]).count() == 60
    assert len({r.cluster for r in clusters.kmeans(df, ["a"]).collect()}) == 4 and seen.value == 120


def test_windows_are_not_dealt_by_kind(spark):
    windows = spark.createDataFrame([(i, 0, [1.0, -1.0] * 8) for i in range(40)], "rec_id long, kind int, x array<double>")
    models = spark.createDataFrame([(0, 9, [0.1, 0.0, 0.0], 0.1, [-1.0, 1.0])], "kind int, n long, a array<double>, width double, residues array<double>")
    found = noise.with_noise(windows, models, 6.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(kind" not in plan and "BroadcastHashJoin" in plan and found.count() == 40


def test_weak_leads_hold_a_part_of_a_batch():
    class Windows:
        schema = {"rec_id": type("Field", (), {"dataType": type("Kind", (), {"simpleString": staticmethod(lambda: "bigint")})})}

        def mapInArrow(self, run, kind):
            return run

    batch = pa.record_batch({"rec_id": pa.array(range(1000), pa.int64()), "x": [[0.0, 1.0, 0.0]] * 1000, "peaks": [[1]] * 1000})
    sizes = [b.num_rows for b in noise.weak_lead_windows(Windows(), 100.0)(iter([batch]))]
    assert sum(sizes) == 1000 and max(sizes) <= noise.ROWS


def test_detectors_hold_a_part_of_a_batch(spark):
    df = spark.createDataFrame([(i, 50.0, [0.0] * 10) for i in range(300)], "rec_id long, fs double, x array<double>").coalesce(1)
    found = detectors.detect_all(df, {"rows": lambda x, fs: [[len(x)]] * len(x)}).collect()
    assert len(found) == 300 and max(r.peaks[0] for r in found) <= detectors.ROWS


def test_hot_windows_take_one_worker_for_each_task(spark, monkeypatch):
    texts = [" ".join(f"w{i * k % 97}" for i in range(300)) for k in (1, 1, 2, 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(superkmers, "HOT", 0)
    spans = superkmers.repeated_spans(common.keyed(docs), suffixes.symbols(64), "test")
    nodes = [x.strip(" :+-*()0123456789").split(" ")[0] for x in spans._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    assert "MapInArrow" in nodes and all(pair != ("MapInArrow", "MapInArrow") for pair in zip(nodes, nodes[1:]))


def test_ordered_slices_hold_a_part_of_a_task():
    held = []

    def repeats(strings, rank):
        held.append(sum(map(len, strings)))
        return np.array([len(x) for x in strings]), np.zeros(held[-1], bool)

    kind = dataclasses.replace(suffixes.symbols(), repeats=repeats)
    batch = lambda k: pa.record_batch({"h": pa.array([k] * 100), "doc_id": pa.array(range(100)), "th": pa.array([0] * 100), "s": pa.array([0] * 100), "packed": pa.array([b"x" * 1000] * 100, pa.binary())})
    list(superkmers._count(kind)(batch(k) for k in range(50)))
    assert sum(held) == 5_000_000 and max(held) <= 1_100_000


def test_line_items_are_sorted_once_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bindings, "DEALT", 50)
    n = 1000
    zero = lambda kind: pa.array([0] * n, kind)
    table = pa.table({
        "l_orderkey": pa.array(range(n), pa.int64()), "l_partkey": zero(pa.int64()), "l_suppkey": pa.array([i % 7 for i in range(n)], pa.int64()), "l_linenumber": zero(pa.int32()),
        "l_quantity": zero(pa.float64()), "l_extendedprice": pa.array([(i * i * 31) % 9973 / 100 for i in range(n)], pa.float64()), "l_shipdate": zero(pa.timestamp("us"))})
    got, want = both(spark, tmp_path, "aug04_noise_model", lineitem=table)
    assert got == want and len(got) == 2
    plan = QUERIES["aug04_noise_model"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "hashpartitioning(rec_id" in plan and ", 20), REPARTITION_BY_NUM" in plan and plan.count("Exchange") == 2


def test_neighbours_of_ranges_and_lengths_are_found_without_a_sort(spark, tmp_path):
    rows = spark.range(20).select(F.lit(1).alias("rec_id"), F.col("id").alias("at"), (F.col("id") * 2.0).alias("v"))
    found = scan.previous(rows, ["at"], scan.every("at", 7), {"p": F.col("v")}, {"n": F.col("v")})
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r.p, r.n) for r in found.orderBy("at").collect()] == [(2.0 * i - 2 if i else None, 2.0 * i + 2 if i < 19 else None) for i in range(20)]
    plan = secondary.prominent_stretch(rows.withColumnRenamed("at", "idx"), rows.select("rec_id", F.col("at").alias("idx")), 50.0, lengths=rows.groupBy("rec_id").agg(F.count("*").alias("n")))
    assert "max(idx" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_intervals_that_go_on_in_the_next_batch(spark):
    rng = np.random.default_rng(3)
    signal = spark.createDataFrame([(r, i, float(x)) for r in ("a", "b") for i, x in enumerate(rng.normal(size=200))], "rec_id string, idx long, v double")
    beats = spark.createDataFrame([(r, i) for r in ("a", "b") for i in range(5, 200, 45)], "rec_id string, idx long")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    want, was = sorted(map(tuple, secondary.intervals(signal, beats, 50.0).collect())), spark.conf.get(key)
    try:
        for n in (1, 7):
            spark.conf.set(key, str(n))
            assert sorted(map(tuple, secondary.intervals(signal, beats, 50.0).collect())) == want
    finally:
        spark.conf.set(key, was)
    assert len(want) == 10 and sum(len(r[3]) for r in want) > 10 and all(not r[3] for r in want if r[1] == 185)
