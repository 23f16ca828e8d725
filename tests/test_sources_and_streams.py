import datetime
import math

import pytest
from pyspark.sql import functions as F

from pulsemill.sources import devices as V, sinks
from pulsemill.streaming import online

EXPORT = """﻿session.acq
1 msec/sample
2 channels
Recording on: 2025-07-02 10:00:00.000
ECG
mV
PPG
Volts
milliSec\tCH1\tCH40\t
\t5 samples\t5 samples\t
0\t0.1\t1.0\t
1\t0.2\tbad\t
junk line
2\t0.3\t3.0\t

3\t0.4\t-99\t
4\t0.5\t5.0\t
"""
START = int(datetime.datetime(2025, 7, 2, 10, tzinfo=datetime.timezone.utc).timestamp() * 1000)


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_acquisition(spark, tmp_path):
    p = write(tmp_path / "a.txt", EXPORT)
    rows = V.read_acquisition(spark, p, "r").orderBy("idx").collect()
    assert [(r.idx, r.ts_ms - START, r.v, r.channel, r.fs) for r in rows] == [(0, 0, 1.0, "CH40", 1000.0), (1, 1, None, "CH40", 1000.0), (2, 2, 3.0, "CH40", 1000.0), (3, 3, None, "CH40", 1000.0), (4, 4, 5.0, "CH40", 1000.0)]
    assert [r.v for r in V.read_acquisition(spark, p, "r", zero_fill=True).orderBy("idx").collect()] == [1.0, 0.0, 3.0, 0.0, 5.0]
    named = V.read_multichannel(spark, p, "r").orderBy("idx").collect()
    assert [r.ECG for r in named] == [0.1, 0.2, 0.3, 0.4, 0.5] and [r.PPG for r in named] == pytest.approx([1.0, 2.0, 3.0, 4.0, 5.0]) and named[0].SKT is None
    with pytest.raises(ValueError, match="column names"):
        V.read_acquisition(spark, write(tmp_path / "none.txt", "nothing\nhere\n"), "r")


@pytest.mark.parametrize("text", ["2025-07-02 10:00:00.000", "2025-07-02 10:00:00", "07/02/2025 10:00:00", "02.07.2025 10:00:00"])
def test_header_dates(text):
    assert V.parse_header([f"Recording on: {text}"]).start_ms == START
    assert V.parse_header(["Recording on: some day"], 7).start_ms == 7


def test_named_rows_keep_the_last_of_a_millisecond(spark, tmp_path):
    text = "0.4 msec/sample\nECG\nmV\nEDA\nuS\nmsec,CH1,CH2\n" + "".join(f"{i},{i}.5,x{i}\n" for i in range(5)) + "9,short\n"
    rows = {r.timestamp_ms: r["values"] for r in V.read_named_rows(spark, write(tmp_path / "n.csv", text), "r").collect()}
    assert rows == {0: {"ECG": "1.5", "EDA": "x1"}, 1: {"ECG": "3.5", "EDA": "x3"}, 2: {"ECG": "4.5", "EDA": "x4"}}


def test_belts(spark, tmp_path):
    lines = ["PC_Time,Seq,InterArrival,ECG"] + [f"{i},{i},8,{'' if i == 3 else i}" for i in range(14)]
    rows = V.read_belt(spark, write(tmp_path / "b.csv", "\n".join(lines)), "r").orderBy("idx").collect()
    assert [r.v for r in rows] == list(map(float, range(14))) and rows[0].fs == 125.0
    few = V.read_belt(spark, write(tmp_path / "f.csv", "\n".join(lines[:6])), "r").collect()
    assert few[0].fs == 100.0
    words = ["timestamp,a,b"] + [f"{1000 + 4 * i},0,{(i << 6) | (i % 4) << 3}" for i in range(9)]
    p = write(tmp_path / "w", "\n".join(words))
    raw = V.read_word_belt(spark, p, "r", "raw").orderBy("idx").collect()
    assert raw[0].fs == 250.0 and [r.ts_ms for r in raw] == [1000 + 4 * i for i in range(9)]
    z = [r.v for r in V.read_word_belt(spark, p, "r").orderBy("idx").collect()]
    assert z[4] == pytest.approx(0, abs=0.2)
    mv = [r.v for r in V.read_word_belt(spark, p, "r", "convert").orderBy("idx").collect()]
    assert sum(mv) == pytest.approx(0, abs=1e-9) and mv[8] - mv[0] == pytest.approx(8000 / (2**17 * 20))
    scaled = V.read_word_belt(spark, p, "r", scale=lambda v: v * 2).orderBy("idx").first()
    assert scaled.v == 0.0
    flat = write(tmp_path / "flat", "\n".join(f"{i},5" for i in range(9)))
    assert all(r.v == 0.0 for r in V.read_word_belt(spark, flat, "r").collect())


def test_logger_folder_in_numeric_order(spark, tmp_path):
    row = lambda ecg, eda, us: ",".join([str(ecg), str(eda)] + ["0"] * 9 + [str(us), "1", "2", "3"])
    write(tmp_path / "10.csv", "h\n" + row(5, 1, 700))
    write(tmp_path / "2.csv", row(3, "bad", 1000) + "\n" + row(4, 1, 1000))
    write(tmp_path / "1.csv", row(1, 1, 500) + "\n1,2,3\n" + row(2, 1, 100))
    rows = V.read_logger(spark, str(tmp_path), "r", 10_000).orderBy("timestamp_ms").collect()
    assert [(r.timestamp_ms, r.ecg) for r in rows] == [(10_000, "2"), (10_002, "4"), (10_003, "5")]


def test_labels_vectors_scores(spark, tmp_path):
    p = write(tmp_path / "l.csv", "timestamp_ms;label\n100;a;dev;s1;sub;t1\n200;b\n200;c\n300;\nx;y\n")
    rows = V.read_labels(spark, p, "r", 5).orderBy("ts_ms").collect()
    assert [(r.ts_ms, r.label, r.device, r.trial) for r in rows] == [(105, "a", "dev", "t1"), (205, "c", "dev", "t1")]
    v = V.read_vectors(spark, write(tmp_path / "v.txt", "1 2.5\n\n 3\tx\n")).orderBy("place").collect()
    assert [r["values"] for r in v] == [[1.0, 2.5], [3.0, None]]
    s = V.read_scores(spark, write(tmp_path / "s.csv", ",two average sitting TP,two average sitting FP,swt TP\n1,5,2,7\n2,,3,8\n")).orderBy("subject", "detector").collect()
    assert [(r.subject, r.detector, r.experiment, r.tp, r.fp) for r in s] == [("1", "swt", None, 7, None), ("1", "two", "average sitting", 5, 2), ("2", "swt", None, 8, None), ("2", "two", "average sitting", None, 3)]
    with pytest.raises(RuntimeError, match="no_such_library"):
        V.outside_reader("records", "no_such_library")


def test_sinks(spark, tmp_path):
    beats = spark.createDataFrame([("r", 1.23456, 71.456, 800.0, 100), ("r", 2.0, float("nan"), None, 900)], "rec_id string, time_s double, hr_bpm double, rr_ms double, t_ms long")
    windows = spark.createDataFrame([("r", 0, 60.0), ("r", 1, None)], "rec_id string, window_idx int, hr_bpm double")
    sinks.write_heart_rate(beats, windows, str(tmp_path), "x")
    back = spark.read.csv(f"{tmp_path}/x_beats", header=True).orderBy("time_s").collect()
    assert [(r.time_s, r.hr_bpm) for r in back] == [("1.2346", "71.46"), ("2.0", None)]
    sinks.write_comparison(windows, windows.groupBy("rec_id").agg(F.avg("hr_bpm").alias("ref_hr")), f"{tmp_path}/c")
    assert spark.read.csv(f"{tmp_path}/c/windows_summary", header=True).count() == 1
    sinks.write_intervals(beats, f"{tmp_path}/rr")
    assert [r.value for r in spark.read.text(f"{tmp_path}/rr").collect()] == ["0.80000"]
    sinks.write_parquet(windows, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2
    samples = spark.createDataFrame([("r", t, float(t)) for t in (10, 20, 30)], "rec_id string, timestamp_ms long, v double")
    assigned = spark.createDataFrame([("r", 20, "dose", 3)], "rec_id string, timestamp_ms long, label string, time_diff_ms long")
    sinks.write_merge(samples, assigned, f"{tmp_path}/m", "reference")
    row = spark.read.csv(f"{tmp_path}/m/label_assignments", header=True).first()
    assert (row.row, row.label, row.time_diff_ms) == ("3", "dose", "3")
    assert sinks.verify(samples, f"{tmp_path}/m/reference_labels") == (0, "Verification OK")
    assert sinks.verify(samples.unionByName(samples.withColumn("timestamp_ms", F.col("timestamp_ms") + 1)), f"{tmp_path}/m/reference_labels") == (3, "Data Loss Detected")


def stream(spark, path, plan, once=False):
    """All rows that a plan over the stream of beats has put out by its end."""
    beats = spark.readStream.schema("rec_id long, ts timestamp, value double").parquet(path)
    name = "t" + str(abs(hash(path)))
    w = plan(beats).writeStream.format("memory").queryName(name).outputMode("append")
    q = (w.trigger(once=True) if once else w).start()
    try:
        # timeouts by the clock keep a query busy for ever, so such a one runs over what is there
        assert q.awaitTermination(60) if once else q.processAllAvailable() is None
        return spark.table(name).collect()
    finally:
        q.stop()


@pytest.fixture
def beats(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(1, at(0.8 * i), 1.0) for i in range(25)] + [(1, at(40 + 0.8 * i), 1.0) for i in range(10)] + [(1, at(1000), 1.0)] + [(1, at(0.85), 1.0)]
    path = str(tmp_path / "beats")
    spark.createDataFrame(rows, "rec_id long, ts timestamp, value double").coalesce(1).write.parquet(path)
    return path


def test_windowed_rate(spark, beats):
    got = {r.start.timestamp(): r for r in stream(spark, beats, online.windowed_rate)}
    assert any(math.isclose(r.hr_bpm, 75, rel_tol=0.02) for r in got.values()) and all(r.n_beats > 0 for r in got.values())


def test_gaps_split_recordings(spark, beats):
    got = sorted(stream(spark, beats, online.split_at_gaps), key=lambda r: r.start)
    assert [r.n_beats for r in got] == [26, 10]


def test_thinned_with_state(spark, beats):
    got = sorted(stream(spark, beats, online.thinned, once=True), key=lambda r: r.ts)
    assert len(got) == 36 and (got[0].rr_ms is None or math.isnan(got[0].rr_ms))
    assert got[5].rr_ms == pytest.approx(800)
