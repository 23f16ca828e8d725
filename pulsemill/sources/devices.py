"""Device text files as DataFrames.

Headers are at most HEADER lines, read at the driver; samples are read in splits. A row is a sample if its first cell is a
number, which leaves headers, sample counts and blank lines out. The order of samples is that of their time column, or,
where a file has none, of their place in the file.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import fills, scan, selection

HEADER = 100
#: Channel codes of a four-channel export, and words that name a channel in another.
CODES = {"ECG": "CH2", "PPG": "CH3", "SKT": "CH7", "EDA": "CH16"}
NAMES = {"ECG": ("ecg", "ekg"), "PPG": ("ppg", "pulse"), "SKT": ("skt", "temperature", "temp"), "EDA": ("eda", "gsr", "electroderm")}
LOGGER = ("ecg", "eda", "ir", "red", "acc_x", "acc_y", "acc_z", "gyr_x", "gyr_y", "gyr_z", "batt", "isi_us", "relative_humidity", "ambient_temp", "body_temp")
DATES = ("%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%m/%d/%Y %H:%M:%S", "%d.%m.%Y %H:%M:%S")
LAST = -1


@dataclass
class Header:
    fs: float = 1000.0
    start_ms: int = 0
    columns: list[str] = field(default_factory=list)
    delimiter: str = "\t"
    names: list[str] = field(default_factory=list)


def _head(spark: SparkSession, path: str) -> list[str]:
    return [r.value.lstrip("﻿") for r in spark.read.text(path).limit(HEADER).collect()]


def _epoch_ms(text: str) -> int | None:
    from datetime import datetime, timezone

    for layout in DATES:
        try:
            return round(datetime.strptime(text.strip(), layout).replace(tzinfo=timezone.utc).timestamp() * 1000)
        except ValueError:
            pass
    return None


def parse_header(lines: list[str], start_ms: int = 0) -> Header:
    """Rate from `n msec/sample`, start from `Recording on:` (UTC; start_ms without one), the row of column names, and the
    channels' names from the lines before it: pairs of a name and its unit, read backwards."""
    h = Header(start_ms=start_ms)
    for i, line in enumerate(lines):
        if m := re.search(r"([\d.]+)\s*(msec|sec)/sample", line):
            step = float(m[1]) * (1000 if m[2] == "sec" else 1)
            h.fs = 1000 / step if step else h.fs
        elif "recording on:" in line.lower():
            found = _epoch_ms(line.split(":", 1)[1])
            h.start_ms = start_ms if found is None else found
        elif re.match(r"\s*(sec|min|m(illi)? ?sec)", line, re.I) and re.search(r"[\t,]", line):
            h.delimiter = "\t" if "\t" in line else ","
            h.columns = [c.strip() for c in line.split(h.delimiter)]
            while h.columns and not h.columns[LAST]:
                h.columns.pop()
            n = len(h.columns) - 1
            # name and unit lines end just before the header, one pair for each channel
            h.names = [lines[i - 2 * (n - k)].strip() if i - 2 * (n - k) >= 0 else "" for k in range(n)]
            break
    return h


def _cells(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """cells (array of strings), place (order in the file), of every line whose first cell is a number."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    cells = F.split(F.regexp_replace("value", "^﻿", ""), re.escape(delimiter))
    rows = lines.select(F.transform(cells, lambda c: F.trim(c)).alias("cells"), F.struct("split", "line").alias("place"))
    return rows.where(F.col("cells")[0].try_cast("double").isNotNull())


def _number(i: int) -> Column:
    return S.valid(F.get("cells", F.lit(i)).try_cast("double"))


def _indexed(rows: DataFrame, *order: str) -> DataFrame:
    """rows of one recording with idx, their number in the order of `order`: of place, or of a time column and place. A task counts a
    split of the file, or a span of time that holds about RANGE_SAMPLES rows."""
    if order[0] == "place":
        at = F.col("place.split")
    else:
        n, lo, hi = rows.agg(F.count("*"), F.min(order[0]), F.max(order[0])).first()
        width = float(hi - lo) / max(1, n // scan.RANGE_SAMPLES) if n else 0.0
        at = F.floor((F.col(order[0]) - lo) / width) if width else F.lit(0)
    return scan.running(rows, list(order), at, {}, "idx")


def pick_channel(columns: list[str], wanted: str | None, fallback: tuple[str, ...]) -> int:
    """Place of the wanted column, by part of its name, else of the first fallback there is, else the second column."""
    for name in (wanted, *fallback):
        for i, c in enumerate(columns):
            if name and i and name.lower() == c.lower():
                return i
    for name in (wanted, *fallback):
        for i, c in enumerate(columns):
            if name and i and name.lower() in c.lower():
                return i
    return 1


def read_acquisition(spark: SparkSession, path: str, rec_id: str, channel: str | None = "CH40", start_ms: int = 0, zero_fill: bool = False) -> DataFrame:
    """samples(rec_id, channel, idx, ts_ms, v) and fs of a text export, tab or comma. Lines of another width are kept as long
    as they have the channel; zero_fill turns missing samples to zero."""
    h = parse_header(_head(spark, path), start_ms)
    if not h.columns:
        raise ValueError(f"{path}: no row of column names in the first {HEADER} lines")
    at = pick_channel(h.columns, channel, ("CH9", "CH40", "CH2"))
    v = F.coalesce(_number(at), F.lit(0.0)) if zero_fill else _number(at)
    rows = _cells(spark, path, h.delimiter).where(F.size("cells") > at).select(F.lit(rec_id).alias("rec_id"), F.lit(h.columns[at]).alias("channel"), _number(0).alias("t"), "place", v.alias("v"))
    rows = _indexed(rows, "t", "place")
    return rows.select("rec_id", "channel", "idx", (F.lit(h.start_ms) + F.col("idx") * (1000.0 / h.fs)).cast("long").alias("ts_ms"), "v", F.lit(h.fs).alias("fs"))


def read_belt(spark: SparkSession, path: str, rec_id: str, start_ms: int = 0) -> DataFrame:
    """A belt's CSV: the first column named like ECG, gaps on the line; the rate is 1000 over the median of InterArrival if
    there are more than ten, else 100."""
    names = [c.strip() for c in _head(spark, path)[0].split(",")]
    ecg = next(i for i, c in enumerate(names) if "ecg" in c.lower())
    gap = next((i for i, c in enumerate(names) if c.lower() == "interarrival"), None)
    rows = _cells(spark, path, ",")
    fs = 100.0
    if gap is not None:
        n, mid = rows.select(_number(gap).alias("g")).agg(F.count("g"), F.percentile("g", 0.5)).first()
        fs = 1000.0 / mid if n > 10 and mid else fs
    s = _indexed(rows.select(F.lit(rec_id).alias("rec_id"), "place", _number(ecg).alias("v")), "place")
    s = fills.interpolate(s, empty=0.0)
    return s.select("rec_id", F.lit(names[ecg]).alias("channel"), "idx", (F.lit(start_ms) + F.col("idx") * (1000.0 / fs)).cast("long").alias("ts_ms"), "v", F.lit(fs).alias("fs"))


def read_word_belt(spark: SparkSession, path: str, rec_id: str, mode: str = "normalize", scale=None) -> DataFrame:
    """A belt's file of a timestamp and channels, header or not; ECG is the last column. mode: raw, normalize (robust z) or
    convert (decode words); scale: a function of the column instead. The rate is 1000 over the median of the steps between
    0 and 100 ms if more than five remain, else 125."""
    rows = _cells(spark, path, ",").select(F.lit(rec_id).alias("rec_id"), _number(0).cast("long").alias("ts_ms"), F.element_at("cells", LAST).try_cast("double").alias("v"), "place")
    rows = _indexed(rows, "ts_ms", "place")
    steps = scan.previous(rows, ["idx"], scan.every("idx", scan.RANGE_SAMPLES), {"d": F.col("ts_ms")}).withColumn("d", F.col("ts_ms") - F.col("d")).where("d > 0 and d < 100")
    fs = steps.groupBy("rec_id").agg(F.when(F.count("*") > 5, 1000.0 / F.percentile("d", 0.5)).alias("fs"))
    if scale is not None:
        rows = rows.withColumn("v", scale(F.col("v")))
    elif mode == "convert":
        rows = fills.interpolate(rows.withColumn("v", S.decode_word(F.col("v").cast("long"))), empty=0.0)
        rows = rows.join(rows.groupBy("rec_id").agg(F.avg("v").alias("mean")), "rec_id").withColumn("v", F.col("v") - F.col("mean"))
    elif mode == "normalize":
        middle = rows.groupBy("rec_id").agg(F.avg("v").alias("mean")).join(selection.median(rows, name="md"), "rec_id", "left")
        off = middle.join(selection.median(rows.join(middle, "rec_id").select("rec_id", F.abs(F.col("v") - F.col("md")).alias("d")), "d", "mad"), "rec_id", "left")
        scaled = F.try_divide(F.col("v") - F.col("md"), 1.4826 * F.col("mad"))
        rows = rows.join(off, "rec_id").withColumn("v", F.when(F.col("mad") > 1e-9, scaled).otherwise(F.col("v") - F.col("mean")))
    rows = rows.join(fs, "rec_id", "left").withColumn("fs", F.coalesce("fs", F.lit(125.0)))
    return rows.select("rec_id", F.lit("ECG").alias("channel"), "idx", "ts_ms", "v", "fs")


def read_multichannel(spark: SparkSession, path: str, rec_id: str, start_ms: int = 0, limit: int = 10) -> DataFrame:
    """Wide rows rec_id, idx, timestamp_ms, ECG, PPG, SKT, EDA, found by channel code or by the names before the header; gaps
    are filled up to `limit` samples along the line, the rest from the next and then the last sample."""
    h = parse_header(_head(spark, path), start_ms)
    at = {}
    for name, code in CODES.items():
        for i, c in enumerate(h.columns[1:], 1):
            label = h.names[i - 1].lower() if i - 1 < len(h.names) else ""
            if c.upper() == code or c.upper() == name or any(w in label for w in NAMES[name]):
                at.setdefault(name, i)
    rows = _cells(spark, path, h.delimiter).select(F.lit(rec_id).alias("rec_id"), _number(0).alias("t"), "place", *[(_number(at[n]) if n in at else F.lit(None).cast("double")).alias(n) for n in CODES])
    rows = _indexed(rows, "t", "place")
    rows = fills.interpolate_limited(rows, limit, "idx", list(at)) if at else rows
    return rows.select("rec_id", "idx", (F.lit(h.start_ms) + F.col("idx") * (1000.0 / h.fs)).cast("long").alias("timestamp_ms"), *CODES)


def read_named_rows(spark: SparkSession, path: str, rec_id: str, start_ms: int = 0) -> DataFrame:
    """Rows of exactly the header's width, as text: rec_id, timestamp_ms, values (channel name -> text). Times are start +
    round(k * step); of rows at one millisecond the last stays."""
    h = parse_header(_head(spark, path), start_ms)
    n = len(h.columns)
    rows = _cells(spark, path, h.delimiter).where(F.size("cells") == n)
    rows = _indexed(rows.select(F.lit(rec_id).alias("rec_id"), "cells", "place"), "place")
    ts = F.lit(h.start_ms) + F.bround(F.col("idx") * (1000.0 / h.fs)).cast("long")
    names = F.array(*[F.lit(x or c) for x, c in zip(h.names, h.columns[1:])])
    return rows.groupBy("rec_id", ts.alias("timestamp_ms")).agg(F.max_by(F.map_from_arrays(names, F.slice("cells", 2, n - 1)), "idx").alias("values"))


def read_logger(spark: SparkSession, folder: str, rec_id: str, start_ms: int = 0) -> DataFrame:
    """A folder of 1.csv, 2.csv, ... in numeric order: times are start + floor(running sum of the intervals / 1000); rows of
    fewer than 12 cells are dropped, those without a number in EDA too, but after their interval has counted."""
    lines = spark.read.text(f"{folder.rstrip('/')}/*.csv").select("value", F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)\.csv$", 1).cast("int").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    rows = lines.withColumn("cells", F.split("value", ",")).where((F.size("cells") >= 12) & F.get("cells", F.lit(11)).try_cast("double").isNotNull())
    rows = rows.withColumn("rec_id", F.lit(rec_id))
    rows = scan.running(rows, ["file", "split", "line"], F.struct("file", "split"), {"us": F.get("cells", F.lit(11)).try_cast("double")}, "n")
    ts = F.lit(start_ms) + F.floor(F.col("us") / 1000)
    good = rows.where(F.get("cells", F.lit(1)).try_cast("double").isNotNull())
    values = F.struct(*[F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(LOGGER)])
    last = good.groupBy("rec_id", ts.alias("timestamp_ms")).agg(F.max_by(values, "n").alias("r"))
    return last.select("rec_id", "timestamp_ms", "r.*")


def read_labels(spark: SparkSession, path: str, rec_id: str, offset_ms: int = 0) -> DataFrame:
    """labels(rec_id, ts_ms, label, device, session, subject, trial): comma, semicolon or tab; rows without a time or a label
    go; of labels at one time the last stays; the first row of six or more cells says what the session was."""
    head = _head(spark, path)
    delimiter = max(",;\t", key=lambda d: sum(line.count(d) for line in head))
    rows = _cells(spark, path, delimiter).withColumn("label", F.get("cells", F.lit(1))).where("label <> ''")
    meta = next((c for line in head if len(c := [x.strip() for x in line.split(delimiter)]) >= 6 and re.match(r"-?[\d.]+$", c[0])), [None] * 6)
    ts = (_number(0) + offset_ms).cast("long")
    out = rows.groupBy(ts.alias("ts_ms")).agg(F.max_by("label", "place").alias("label"))
    return out.select(F.lit(rec_id).alias("rec_id"), "ts_ms", "label", *[F.lit(m).cast("string").alias(n) for n, m in zip(("device", "session", "subject", "trial"), meta[2:6])])


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """place, values: whitespace-separated numbers, a line a row, as templates come."""
    rows = spark.read.text(path).select(F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line")).alias("place"), F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "").alias("cells"))
    return rows.where(F.size("cells") > 0).select("place", F.transform("cells", lambda x: x.try_cast("double")).alias("values"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """subject, detector, experiment (null without one), tp, fp, fn, tn from a wide table whose columns are named
    `<detector> <experiment> TP` or `<detector> TP`."""
    wide = spark.read.csv(path, header=True)
    key, *names = wide.columns
    cells = wide.select(F.col(f"`{key}`").alias("subject"), F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"`{n}`"))])).alias("cell", "n"))
    parts = F.split("cell", " ")
    what = cells.select("subject", parts[0].alias("detector"), F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 2, F.size(parts) - 2), " ")).alias("experiment"), F.lower(F.element_at(parts, LAST)).alias("kind"), F.col("n").try_cast("int").alias("n"))
    return what.groupBy("subject", "detector", "experiment").pivot("kind", ["tp", "fp", "fn", "tn"]).agg(F.first("n"))


def outside_reader(kind: str, library: str):
    """Binary formats need a library that may be missing; the reader then says which."""
    import importlib

    try:
        return importlib.import_module(library)
    except ImportError as e:
        raise RuntimeError(f"reading {kind} needs the Python package {library}") from e
