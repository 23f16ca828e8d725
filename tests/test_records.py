"""Waveform records and MATLAB arrays written by these tests and read back, in one range and in many."""

import struct
import zlib

import numpy as np
import pytest

from pulsemill.sources import records


@pytest.fixture(scope="module", autouse=True)
def sources(spark):
    records.register(spark)


def pack(x, kind):
    x = np.asarray(x).ravel()
    if kind == "16":
        return x.astype("<i2").tobytes()
    x = np.append(x, 0) if len(x) % 2 else x
    a, b = (x[k::2].astype(int) & 0xFFF for k in (0, 1))
    return np.column_stack([a & 255, a >> 8 | (b >> 8) << 4, b & 255]).astype(np.uint8).tobytes()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("records")
    rng = np.random.default_rng(1)
    x = rng.integers(-2047, 2048, (1001, 3))
    x[5, 1] = -2048
    y = rng.integers(-32767, 32768, (700, 2))
    y[9, 0] = -32768
    (out / "a.dat").write_bytes(b"head" + pack(x, "212"))
    (out / "a.hea").write_text("# a comment\na 3 360/360 1001\na.dat 212+4 200(12)/mV 11 1024 995 -22131 0 MLII\na.dat 212+4 100/uV 11 7 0 0 0 V 5\na.dat 212+4 0 11 0 0 0 0\n")
    (out / "b.dat").write_bytes(pack(y, "16"))
    (out / "b.hea").write_text("b 2 500\nb.dat 16 1000/mV 16 0 0 0 0 I\nb.dat 16 1000/mV 16 0 0 0 0 II\n")
    return out, x, y


@pytest.mark.parametrize("span, batch", [(1 << 20, 1 << 16), (64, 30)])
def test_waveforms(spark, monkeypatch, folder, span, batch):
    monkeypatch.setattr(records, "RANGE", span)
    out, x, y = folder
    reader = records._Wfdb(str(out))
    parts = reader.partitions()
    assert len(parts) == (2 if span > 2000 else 16 + 11)
    monkeypatch.setattr(records, "BATCH", batch)
    got = {}
    for p in parts:
        for b in reader.read(p):
            for r in b.to_pylist():
                got[r["rec_id"], r["channel"], r["idx"]] = (r["v"], r["units"], r["fs"])
    want = {}
    for j, (name, gain, base, units) in enumerate([("MLII", 200, 12, "mV"), ("V 5", 100, 7, "uV"), ("signal 2", 200, 0, "mV")]):
        want |= {("a", name, i): (None if v == -2048 else (v - base) / gain, units, 360.0) for i, v in enumerate(x[:, j].tolist())}
    for j, name in enumerate(("I", "II")):
        want |= {("b", name, i): (None if v == -32768 else v / 1000, "mV", 500.0) for i, v in enumerate(y[:, j].tolist())}
    assert got == want


def test_waveforms_through_spark(spark, folder):
    out, x, y = folder
    df = spark.read.format("wfdb").load(str(out))
    assert df.count() == 3 * 1001 + 2 * 700 and df.where("v is null").count() == 2
    one = spark.read.format("wfdb").load(f"{out}/b.hea").where("channel = 'II'").orderBy("idx").collect()
    assert [r.v for r in one] == pytest.approx((y[:, 1] / 1000).tolist())


def test_what_cannot_be_read(tmp_path):
    for kind in ("80", "16x2", "212:3"):
        with pytest.raises(ValueError, match="formats 16 and 212"):
            records.parse_record(f"r 1 100 10\nr.dat {kind} 200 11 0 0 0 0 x\n")


def word(code, value):
    return struct.pack("<H", code << 10 | value & 0x3FF)


def test_annotations(spark, tmp_path):
    far = 70_000
    data = word(28, 18) + word(63, 3) + b"(N\0\0" + word(1, 300) + word(61, -1) + word(59, 0) + struct.pack("<hH", far >> 16, far & 0xFFFF) + word(5, 0) + word(62, 1) + word(60, 3) + word(45, 7) + word(41, 1) + b"\0\0" + word(1, 1)
    (tmp_path / "r.atr").write_bytes(data)
    (tmp_path / "s.atr").write_bytes(b"\0\0")
    (tmp_path / "r.qrs").write_bytes(word(1, 5) + b"\0\0")
    rows = [tuple(r) for r in spark.read.format("wfdb_annotations").load(str(tmp_path)).orderBy("idx").collect()]
    assert rows == [("r", 18, "+", 0, 0, 0, "(N"), ("r", 318, "N", -1, 0, 0, None), ("r", 70_318, "V", 0, 1, 3, None), ("r", 70_325, "[45]", 0, 1, 3, None), ("r", 70_326, "r", 0, 1, 3, None)]
    assert [r.idx for r in spark.read.format("wfdb_annotations").option("extension", "qrs").load(str(tmp_path)).collect()] == [5]


def matrix(name, x, order="<", small=False):
    def element(kind, body):
        if small and len(body) <= 4:
            return struct.pack(f"{order}I", len(body) << 16 | kind) + body.ljust(4, b"\0")
        return struct.pack(f"{order}II", kind, len(body)) + body + bytes(-len(body) % 8)

    kinds = {"i1": 1, "u1": 2, "i2": 3, "f8": 9, "f4": 7, "i4": 5}
    kind = x.dtype.str[1:]
    body = element(6, struct.pack(f"{order}II", 6, 0)) + element(5, struct.pack(f"{order}ii", *x.shape)) + element(1, name.encode()) + element(kinds[kind], x.astype(order + kind).tobytes("F"))
    return struct.pack(f"{order}II", 14, len(body)) + body


def test_matlab_arrays(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    ecg, peaks, grid = rng.normal(size=(500, 1)), np.array([[3, 90, 200]], "i2"), np.arange(6, dtype="f4").reshape(2, 3)
    head = lambda order: b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack(f"{order}H", 0x0100) + (b"IM" if order == "<" else b"MI")
    packed = zlib.compress(matrix("R_peak", peaks))
    other = struct.pack("<II", 14, 16) + struct.pack("<IIII", 6, 8, 1, 0)  # a structure: no array of numbers
    (tmp_path / "one.mat").write_bytes(head("<") + matrix("ecg", ecg) + struct.pack("<II", 15, len(packed)) + packed + other + matrix("g", grid, small=True))
    (tmp_path / "two.mat").write_bytes(head(">") + matrix("ecg", ecg[:7], ">"))
    df = spark.read.format("matlab").load(str(tmp_path))
    got = {}
    for r in df.collect():
        got.setdefault((r.rec_id, r.variable), {})[r.idx] = r.v
    want = {("one", "ecg"): ecg.ravel(), ("one", "R_peak"): peaks.ravel(), ("one", "g"): grid.ravel("F"), ("two", "ecg"): ecg[:7].ravel()}
    assert got == {k: dict(enumerate(map(float, v))) for k, v in want.items()}
    assert spark.read.format("matlab").option("variable", "R_peak").load(f"{tmp_path}/one.mat").count() == 3
    monkeypatch.setattr(records, "RANGE", 64)
    reader = records._Matlab(f"{tmp_path}/one.mat", "ecg")
    parts = reader.partitions()
    assert len(parts) == 8
    assert np.concatenate([b.column("v").to_numpy() for p in parts for b in reader.read(p)]).tolist() == ecg.ravel().tolist()
