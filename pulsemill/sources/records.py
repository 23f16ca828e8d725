"""Binary recordings as Spark data sources: waveform records with their annotations, and arrays of MATLAB files (version 5).

    records.register(spark)
    spark.read.format("wfdb").load(folder)              # rec_id, channel, idx, v, units, fs
    spark.read.format("wfdb_annotations").option("extension", "atr").load(folder)   # rec_id, idx, symbol, subtype, chan, num, aux
    spark.read.format("matlab").option("variable", "ecg").load(folder)              # rec_id, variable, idx, v

A path is a file or a folder. Samples are read in ranges of bytes, one for each task, so that a long record is spread. Files are
opened through Arrow's file systems.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Samples of a channel that a task reads, and those of a batch.
RANGE, BATCH = 1 << 20, 1 << 16
#: Symbols of annotation codes 0 to 41, and codes of what modifies an annotation.
SYMBOLS = [" ", "N", "L", "R", "a", "V", "F", "J", "A", "S", "E", "j", "/", "Q", "~", "[15]", "|", "[17]", "s", "T", "*", "D", '"', "=", "p", "B", "^", "t", "+", "u", "?", "!", "[", "]", "e", "n", "@", "x", "f", "(", ")", "r"]
SKIP, NUM, SUB, CHN, AUX = 59, 60, 61, 62, 63
#: What marks a sample that was not measured, by format.
MISSING = {"16": -32768, "212": -2048}
#: Element types of MATLAB files.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, COMPRESSED = 14, 15


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith(("file:", "hdfs:")) else (pafs.LocalFileSystem(), path)


def _files(path: str, extension: str) -> list[str]:
    fs, at = _opened(path)
    if fs.get_file_info(at).type != pafs.FileType.Directory:
        return [path if path.endswith(f".{extension}") else f"{path}.{extension}"]
    found = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.path.endswith(f".{extension}"))
    return [f"{path.rstrip('/')}/{f.rsplit('/', 1)[1]}" for f in found]


def _bytes(path: str, at: int = 0, size: int | None = None) -> bytes:
    fs, name = _opened(path)
    with fs.open_input_file(name) as f:
        f.seek(at)
        return f.read(size) if size is not None else f.read()


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


# --- waveform records


@dataclass
class Signal:
    file: str
    kind: str
    start: int
    gain: float
    baseline: int
    units: str
    name: str


def parse_record(text: str) -> tuple[float, int | None, list[Signal]]:
    """Samples a second, samples of a channel (None if the header doesn't say) and signals of a header's text."""
    lines = [x.strip() for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]
    first = lines[0].split()
    fs = float(first[2].split("/")[0]) if len(first) > 2 else 250.0
    n = int(first[3]) if len(first) > 3 and int(first[3]) else None
    signals = []
    for line in lines[1 : int(first[1].split("/")[0]) + 1]:
        parts = line.split(None, 8)
        kind = re.fullmatch(r"(\d+)(?:x(\d+))?(?::(\d+))?(?:\+(\d+))?", parts[1])
        if not kind or kind[1] not in MISSING or int(kind[2] or 1) != 1 or int(kind[3] or 0):
            raise ValueError(f"{parts[0]}: only formats 16 and 212, one sample a frame without skew, can be read, not {parts[1]}")
        level = re.fullmatch(r"([-\d.eE+]+)(?:\((-?\d+)\))?(?:/(\S+))?", parts[2] if len(parts) > 2 else "200")
        zero = int(parts[4]) if len(parts) > 4 else 0
        signals.append(Signal(parts[0], kind[1], int(kind[4] or 0), float(level[1]) or 200.0, int(level[2]) if level[2] else zero, level[3] or "mV", parts[8] if len(parts) > 8 else f"signal {len(signals)}"))
    return fs, n, signals


def decode(data: bytes, kind: str) -> np.ndarray:
    """Integer samples of bytes in format 16 or, from an even sample on, 212."""
    if kind == "16":
        return np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.int32)
    odd = len(data) % 3
    triples = np.frombuffer(data + bytes(-len(data) % 3), np.uint8).reshape(-1, 3).astype(np.int32)
    out = np.empty((len(triples), 2), np.int32)
    out[:, 0] = triples[:, 0] | (triples[:, 1] & 0x0F) << 8
    out[:, 1] = triples[:, 2] | (triples[:, 1] & 0xF0) << 4
    out = out.ravel()
    out[out > 2047] -= 4096
    return out[:-1] if odd == 2 else out[:-2] if odd else out


@dataclass
class Span(InputPartition):
    path: str
    begin: int
    end: int


class _Wfdb(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    @staticmethod
    def _groups(header: str) -> tuple[float, int, dict[str, list[Signal]]]:
        """Rate, samples of a channel, and signals by the file that interleaves them."""
        fs, n, signals = parse_record(_bytes(header).decode("latin-1"))
        groups: dict[str, list[Signal]] = {}
        for s in signals:
            groups.setdefault(s.file, []).append(s)
        if n is None:
            sizes = []
            for file, own in groups.items():
                store, at = _opened(f"{header.rsplit('/', 1)[0]}/{file}")
                sizes.append((store.get_file_info(at).size - own[0].start) * (2 if own[0].kind == "212" else 1) // (3 if own[0].kind == "212" else 2) // len(own))
            n = min(sizes, default=0)
        return fs, n, groups

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for header in _files(self.path, "hea"):
            _, n, _ = self._groups(header)
            out += [Span(header, lo, min(n, lo + RANGE)) for lo in range(0, n, RANGE)]  # RANGE is even: pairs of samples stay whole
        return out

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        fs, _, groups = self._groups(partition.path)
        folder, rec = partition.path.rsplit("/", 1)[0], _name(partition.path)
        for file, own in groups.items():
            kind, k = own[0].kind, len(own)
            for lo in range(partition.begin, partition.end, BATCH):
                hi = min(partition.end, lo + BATCH)
                # lo is even, so that a pair of samples in three bytes begins there
                at, size = (lo * k * 3 // 2, ((hi - lo) * k + 1) * 3 // 2) if kind == "212" else (lo * k * 2, (hi - lo) * k * 2)
                x = decode(_bytes(f"{folder}/{file}", own[0].start + at, size), kind)[: (hi - lo) * k]
                x = x[: len(x) // k * k].reshape(-1, k)
                for j, s in enumerate(own):
                    gone = x[:, j] == MISSING[kind]
                    v = pa.array((x[:, j] - s.baseline) / s.gain, mask=gone)
                    same = [pa.array([c] * len(x), t) for c, t in ((rec, pa.string()), (s.name, pa.string()))]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(lo, lo + len(x))), v, pa.array([s.units] * len(x), pa.string()), pa.array([fs] * len(x), pa.float64())], ["rec_id", "channel", "idx", "v", "units", "fs"])


class WfdbSource(DataSource):
    """Samples of waveform records in physical units; a sample that was not measured is null."""

    @classmethod
    def name(cls) -> str:
        return "wfdb"

    def schema(self) -> str:
        return "rec_id string, channel string, idx long, v double, units string, fs double"

    def reader(self, schema) -> DataSourceReader:
        return _Wfdb(self.options["path"])


def annotations(data: bytes) -> list[tuple[int, str, int, int, int, str | None]]:
    """(idx, symbol, subtype, chan, num, aux) of an annotation file's bytes."""
    out: list[list] = []
    at, now, chan, num = 0, 0, 0, 0
    while at + 1 < len(data):
        word = data[at] | data[at + 1] << 8
        at += 2
        code, value = word >> 10, word & 0x3FF
        if not word:
            break
        if code == SKIP:
            high, low = struct.unpack_from("<hH", data, at)
            now, at = now + (high << 16) + low, at + 4
        elif code == NUM:
            num = out[-1][4] = value - 1024 if value > 511 else value
        elif code == SUB:
            out[-1][2] = value - 1024 if value > 511 else value
        elif code == CHN:
            chan = out[-1][3] = value
        elif code == AUX:
            out[-1][5] = data[at : at + value].rstrip(b"\0").decode("latin-1")
            at += value + value % 2
        else:
            now += value
            out.append([now, SYMBOLS[code] if code < len(SYMBOLS) else f"[{code}]", 0, chan, num, None])
    return [tuple(x) for x in out]


class _Annotations(DataSourceReader):
    def __init__(self, path: str, extension: str) -> None:
        self.path, self.extension = path, extension

    def partitions(self) -> list[InputPartition]:
        return [Span(f, 0, 0) for f in _files(self.path, self.extension)]

    def read(self, partition: Span) -> Iterator[tuple]:
        for row in annotations(_bytes(partition.path)):
            yield (_name(partition.path), *row)


class AnnotationSource(DataSource):
    """Annotations of waveform records; times are differences, so a file is one task."""

    @classmethod
    def name(cls) -> str:
        return "wfdb_annotations"

    def schema(self) -> str:
        return "rec_id string, idx long, symbol string, subtype int, chan int, num int, aux string"

    def reader(self, schema) -> DataSourceReader:
        return _Annotations(self.options["path"], self.options.get("extension", "atr"))


# --- MATLAB arrays


@dataclass
class Array:
    """A real numeric array: its name and the type, place and number of its values; body: the bytes, where they were compressed."""

    name: str
    kind: str
    at: int
    n: int
    body: bytes | None = None


def _element(data: bytes, at: int, order: str) -> tuple[int, int, int, int]:
    """Type, size, place of the values, and place behind them, of the element at a place."""
    kind, size = struct.unpack_from(f"{order}II", data, at)
    if kind >> 16:  # a small element holds its values in its tag
        return kind & 0xFFFF, kind >> 16, at + 4, at + 8
    return kind, size, at + 8, at + 8 + size + (-size % 8 if kind != COMPRESSED else 0)


def _array(data: bytes, at: int, end: int, order: str) -> Array | None:
    """The array in the matrix element whose parts lie between at and end; None if it is no array of numbers."""
    parts = []
    while at < end and len(parts) < 4:
        kind, size, begin, at = _element(data, at, order)
        parts.append((kind, size, begin))
    if len(parts) < 4 or parts[3][0] not in NUMBERS:
        return None
    name = data[parts[2][2] : parts[2][2] + parts[2][1]].decode("latin-1")
    kind = order + NUMBERS[parts[3][0]]
    return Array(name, kind, parts[3][2], parts[3][1] // np.dtype(kind).itemsize)


def arrays(path: str) -> list[Array]:
    """The arrays of a file; places are in the file, or in `body` where an array was compressed."""
    data = _bytes(path)
    order = "<" if data[126:128] == b"IM" else ">"
    out, at = [], 128
    while at + 8 <= len(data):
        kind, size, begin, behind = _element(data, at, order)
        if kind == COMPRESSED:
            body = zlib.decompress(data[begin : begin + size])
            inner, length, start, _ = _element(body, 0, order)
            found = _array(body, start, start + length, order) if inner == MATRIX else None
            if found:
                found.body = body
        else:
            found = _array(data, begin, begin + size, order) if kind == MATRIX else None
        if found:
            out.append(found)
        at = behind
    return out


@dataclass
class Part(InputPartition):
    path: str
    variable: str
    kind: str
    at: int
    begin: int
    end: int
    packed: bool


class _Matlab(DataSourceReader):
    def __init__(self, path: str, variable: str | None) -> None:
        self.path, self.variable = path, variable

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in _files(self.path, "mat"):
            for a in arrays(path):
                if self.variable in (None, a.name):
                    step = max(1, a.n) if a.body is not None else RANGE  # what is compressed is one task
                    out += [Part(path, a.name, a.kind, a.at, lo, min(a.n, lo + step), a.body is not None) for lo in range(0, a.n, step)]
        return out

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        p, width = partition, np.dtype(partition.kind).itemsize
        body = next(a.body for a in arrays(p.path) if a.name == p.variable) if p.packed else None
        for lo in range(p.begin, p.end, BATCH):
            hi = min(p.end, lo + BATCH)
            own = body[p.at + lo * width : p.at + hi * width] if body is not None else _bytes(p.path, p.at + lo * width, (hi - lo) * width)
            v = np.frombuffer(own, p.kind).astype(float)
            same = [pa.array([c] * len(v), pa.string()) for c in (_name(p.path), p.variable)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(lo, hi)), pa.array(v)], ["rec_id", "variable", "idx", "v"])


class MatlabSource(DataSource):
    """Values of the numeric arrays of MATLAB files, version 5, column by column; other variables are left out."""

    @classmethod
    def name(cls) -> str:
        return "matlab"

    def schema(self) -> str:
        return "rec_id string, variable string, idx long, v double"

    def reader(self, schema) -> DataSourceReader:
        return _Matlab(self.options["path"], self.options.get("variable"))


def register(spark: SparkSession) -> None:
    for source in (WfdbSource, AnnotationSource, MatlabSource):
        spark.dataSource.register(source)
