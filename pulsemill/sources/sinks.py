"""Results as files: CSV reports, text for heart-rate tools, Parquet by recording, and a check of what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scan

#: Digits of the columns of reports; others go as they are.
DIGITS = {"time_s": 4, "hr_bpm": 2, "rr_ms": 2, "qrs_energy_ratio": 4, "snr_db": 2, "kurtosis": 3, "skewness": 3, "nk_sqi": 3, "ref_hr": 2, "test_hr": 2, "error": 2}


def _report(df: DataFrame) -> DataFrame:
    """Rounded, with missing numbers empty."""
    out = []
    for c, kind in df.dtypes:
        x = F.when(F.isnan(c), None).otherwise(F.col(c)) if kind in ("double", "float") else F.col(c)
        out.append((F.round(x, DIGITS[c]) if c in DIGITS else x).alias(c))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """One file only for summaries, whose rows are few."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")


def write_heart_rate(beats: DataFrame, windows: DataFrame, path: str, label: str) -> None:
    write_csv(_report(beats).orderBy("rec_id", "time_s"), f"{path}/{label}_beats")
    write_csv(_report(windows).orderBy("rec_id", "window_idx"), f"{path}/{label}_windows")


def write_comparison(windows: DataFrame, summary: DataFrame, path: str) -> None:
    write_csv(_report(windows), f"{path}/windows")
    write_csv(_report(summary), f"{path}/windows_summary", one_file=True)


def write_merge(samples: DataFrame, assigned: DataFrame, path: str, name: str) -> None:
    """samples(rec_id, timestamp_ms, ...) with the label of each, and the assignments (rec_id, timestamp_ms, label,
    time_diff_ms) with the row that each went to, counted from 1 below the header."""
    rows = scan.running(samples, ["timestamp_ms"], scan.every("timestamp_ms", scan.RANGE_MS), {}, "row").withColumn("row", F.col("row") + 2)
    own = assigned.select("rec_id", "timestamp_ms", "label", "time_diff_ms")
    both = rows.join(own, ["rec_id", "timestamp_ms"], "left")
    write_csv(both.drop("row", "time_diff_ms").na.fill("", ["label"]), f"{path}/{name}_labels")
    write_csv(both.where("time_diff_ms is not null").select("rec_id", "row", "timestamp_ms", "label", "time_diff_ms"), f"{path}/label_assignments")


def write_parquet(df: DataFrame, path: str, by: str = "rec_id") -> None:
    df.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)


def write_shards(records: DataFrame, path: str, rows: int = 1000) -> None:
    """Training records, arrays as they are, in Parquet files of at most so many rows each."""
    records.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, n_rows of every file that was written there."""
    return spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n_rows"))


def write_intervals(beats: DataFrame, path: str) -> None:
    """Intervals in seconds to five digits, one a line, in a folder for each recording."""
    lines = beats.where("rr_ms is not null").select("rec_id", "t_ms", F.format_string("%.5f", F.col("rr_ms") / 1000).alias("value"))
    lines.repartition("rec_id").sortWithinPartitions("rec_id", "t_ms").select("rec_id", "value").write.mode("overwrite").partitionBy("rec_id").text(path)


def verify(expected: DataFrame, path: str, key: str = "timestamp_ms") -> tuple[int, str]:
    """Distinct times of the input less the rows written, and what that means."""
    spark = expected.sparkSession
    lost = expected.select(key).distinct().count() - spark.read.csv(path, header=True).count()
    return lost, "Verification OK" if lost == 0 else "Data Loss Detected"
