"""Scans along a recording give the same whether it is one range or many, and whatever its partitions."""

import random

import pytest
from pyspark.sql import functions as F

from pulsemill.operators import fills, joins, scan
from pulsemill.sources import devices

WIDTHS = [1, 7, 50, 10_000]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = [("a", i, rng.randrange(0, 400), rng.choice([None, 1.0, 2.5, -3.0])) for i in range(300)]
    return out + [("b", 900, 5, None), ("c", 901, 5, 1.0), ("c", 902, -17, 2.0)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "rec_id string, peak_id long, t_ms long, v double").repartition(8)


def ordered(rows, rec):
    return sorted((r for r in rows if r[0] == rec), key=lambda r: (r[2], r[1]))


@pytest.mark.parametrize("width", WIDTHS)
def test_sums_and_numbers(table, rows, width):
    got = scan.running(table, ["t_ms", "peak_id"], scan.every("t_ms", width), {"s": F.col("v")}, "n").collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"rec_id", "peak_id", "t_ms", "v", "s", "n"}
    by = {r.peak_id: r for r in got}
    for rec in "abc":
        total, any_ = 0.0, False
        for n, r in enumerate(ordered(rows, rec)):
            total, any_ = total + (r[3] or 0), any_ or r[3] is not None
            assert by[r[1]].n == n and by[r[1]].s == (total if any_ else None)


@pytest.mark.parametrize("width", WIDTHS)
def test_marks_are_carried_both_ways(table, rows, width):
    got = {}
    for forward in (False, True):
        mark = {"m": F.when(F.col("v") > 2, F.col("peak_id"))}
        found = scan.carried(table, ["t_ms", "peak_id"], scan.every("t_ms", width), None if forward else mark, mark if forward else None)
        got[forward] = {r.peak_id: r.m for r in found.collect()}
    before = {r.peak_id: r.p for r in scan.previous(table, ["t_ms", "peak_id"], scan.every("t_ms", width), {"p": F.col("peak_id")}).collect()}
    for rec in "abc":
        own = ordered(rows, rec)
        for i, r in enumerate(own):
            marks = lambda part: [x[1] for x in part if x[3] is not None and x[3] > 2]
            assert got[False][r[1]] == (marks(own[: i + 1]) or [None])[-1]
            assert got[True][r[1]] == (marks(own[i:]) or [None])[0]
            assert before[r[1]] == (own[i - 1][1] if i else None)


@pytest.mark.parametrize("width", WIDTHS)
@pytest.mark.parametrize("strict", [False, True])
def test_as_of_joins_do_not_see_ranges(spark, table, rows, width, strict):
    marks = [("a", 1000 + i, t) for i, t in enumerate([3, 3, 40, 41, 390, 5000])] + [("c", 2000, 5), ("d", 3000, 1)]
    m = spark.createDataFrame(marks, "rec_id string, peak_id long, t_ms long").repartition(8)
    back = {r.peak_id: r.m for r in joins.last_before(table, m, {"peak_id": "m"}, strict=strict, width=width).collect()}
    ahead = {r.peak_id: r.m for r in joins.first_after(table, m, {"peak_id": "m"}, strict=strict, width=width).collect()}
    assert len(back) == len(ahead) == len(rows)
    for rec, pid, t, _ in rows:
        own = [(mt, mp) for r, mp, mt in marks if r == rec]
        b = [x for x in own if (x[0] < t if strict else x[0] <= t)]
        a = [x for x in own if (x[0] > t if strict else x[0] >= t)]
        assert back[pid] == (max(b)[1] if b else None) and ahead[pid] == (min(a)[1] if a else None)


@pytest.mark.parametrize("width", [3, 1 << 20])
def test_fills_do_not_see_ranges(spark, width):
    data = [("r", i, None if i % 11 < 6 or i > 90 or i < 4 else float(i * i)) for i in range(100)]
    df = spark.createDataFrame(data, "rec_id string, idx long, v double").repartition(8)
    want = {r.idx: r.v for r in fills.interpolate(df).collect()}
    got = {r.idx: r.v for r in fills.interpolate(df, width=width).collect()}
    assert got == pytest.approx(want) and got[0] == 36.0 and got[99] == got[88]


def test_files_of_many_splits(spark, tmp_path, monkeypatch):
    """A file read in splits of some lines, and ranges of some rows, has the numbers and clock of one read whole."""
    monkeypatch.setattr(scan, "RANGE_SAMPLES", 16)
    key = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(key)
    export = tmp_path / "a.txt"
    export.write_text("1 msec/sample\nmilliSec\tCH1\tCH40\n" + "".join(f"{i}\t{i}\t{i * 2}\n" for i in range(200)))
    named = tmp_path / "n.csv"
    named.write_text("0.4 msec/sample\nECG\nmV\nmsec,CH1\n" + "".join(f"{i},v{i}\n" for i in range(200)))
    belt = tmp_path / "w"
    belt.write_text("".join(f"{1000 + 4 * i},{i % 9}\n" for i in range(200)))
    logs = tmp_path / "logs"
    logs.mkdir()
    for f in (1, 2, 10):
        (logs / f"{f}.csv").write_text("".join(",".join([str(f * 1000 + i), "1"] + ["0"] * 9 + ["700", "1", "2", "3"]) + "\n" for i in range(60)))

    def read():
        a = [(r.idx, r.ts_ms, r.v) for r in devices.read_acquisition(spark, str(export), "r").orderBy("idx").collect()]
        n = sorted((r.timestamp_ms, r["values"]["ECG"]) for r in devices.read_named_rows(spark, str(named), "r").collect())
        w = [(r.idx, r.ts_ms, round(r.v, 9), r.fs) for r in devices.read_word_belt(spark, str(belt), "r").orderBy("idx").collect()]
        c = [(r.idx, round(r.v, 9)) for r in devices.read_word_belt(spark, str(belt), "r", "convert").orderBy("idx").collect()]
        g = sorted((r.timestamp_ms, r.ecg) for r in devices.read_logger(spark, str(logs), "r").collect())
        return a, n, w, c, g

    whole = read()
    assert [x[0] for x in whole[0]] == list(range(200)) and whole[0][7] == (7, 7, 14.0) and whole[2][0][3] == 250.0
    assert whole[4][-1] == (126, "10059")  # floor(180 * 700 / 1000)
    try:
        spark.conf.set(key, "300b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert spark.read.text(str(export)).rdd.getNumPartitions() > 4
        assert read() == whole
    finally:
        spark.conf.set(key, was)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_what_is_ahead_is_no_frame_with_an_open_end(spark, table):
    """Such a frame is gone through anew for every row; and the ends of ranges on a grid are aggregated without a sort."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    ahead = scan.carried(table, ["t_ms", "peak_id"], scan.every("t_ms", 50), None, {"m": F.col("v")})
    points = spark.createDataFrame([("r", 0, 1.0), ("r", 40, 3.0), ("s", 7, 2.0)], "rec_id string, x long, v double")
    grid = spark.createDataFrame([("r", -5), ("r", 0), ("r", 10), ("r", 40), ("r", 41), ("s", 8), ("t", 1)], "rec_id string, x long")
    found = fills.on_grid(points, grid)
    assert "unboundedfollowing" not in (plan(ahead) + plan(found)).lower() and "SortAggregate" not in plan(found)
    assert sorted(map(tuple, found.collect()), key=str) == [("r", -5, 1.0), ("r", 0, 1.0), ("r", 10, 1.5), ("r", 40, 3.0), ("r", 41, 3.0), ("s", 8, 2.0), ("t", 1, None)]
