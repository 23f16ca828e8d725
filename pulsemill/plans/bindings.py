"""The operators' inputs read out of the tables of a data folder.

Peaks are events on a virtual clock in which 10 hours are a second; a user is a recording. Samples are a supplier's
line items in order of shipment. Frames are embeddings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START_US = 1704067200000000
TICK_US = 36000000

#: The same inputs in SQL.
EV = f"""ev AS (SELECT user_id AS rec_id, event_id AS peak_id,
  (epoch_us(ts) - {START_US}) // {TICK_US} AS t_ms, event_type, value, props FROM events)"""
SM = """sm AS (SELECT l_suppkey AS rec_id,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS idx,
  l_extendedprice AS v, round(l_extendedprice * 100) AS c, l_quantity AS q, l_orderkey, l_partkey FROM lineitem)"""
FR = """fr AS (SELECT vec_id AS rec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"""
FS = f"""{FR}, fs AS (SELECT rec_id, label, unnest(range(0, len(x))) AS idx, unnest(x) AS v FROM fr)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, peak_id, t_ms, event_type, value, props."""
    t = F.expr(f"(unix_micros(cast(ts AS timestamp)) - {START_US}) div {TICK_US}")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("rec_id"), F.col("event_id").alias("peak_id"), t.alias("t_ms"), "event_type", "value", "props")


#: Longer recordings: fifteen users each, on a clock in which an hour is a second.
LONG_EV = f"""ev AS (SELECT user_id // 15 AS rec_id, event_id AS peak_id, (epoch_us(ts) - {START_US}) // {TICK_US // 10} AS t_ms FROM events)"""


def long_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, peak_id, t_ms."""
    t = F.expr(f"(unix_micros(cast(ts AS timestamp)) - {START_US}) div {TICK_US // 10}")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr("user_id div 15").alias("rec_id"), F.col("event_id").alias("peak_id"), t.alias("t_ms"))


def peaks(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The peaks (or labels, or marks) that are events of one type."""
    return events(spark, sf_dir).where(F.col("event_type") == kind).drop("event_type")


#: Line items that a task sorts. Where there are more for each of the session's shuffle partitions, they go to more tasks.
DEALT = 500_000
#: The columns that line items of a supplier are put in order by.
ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with rec_id for l_suppkey, dealt by it to so many tasks that what one of them sorts does not grow with the table."""
    found = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnRenamed("l_suppkey", "rec_id")
    tasks = -(-found.count() // DEALT)
    return found.repartition(tasks, "rec_id") if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else found


def samples(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """rec_id, idx (from 0), v (price), c (price in cents: a whole number, so that sums are exact in any order), q (quantity),
    l_orderkey, l_partkey, and more columns of line items. Rows are sorted by ORDER; what is asked for in that order is not sorted again,
    and what is asked for by rec_id is not shuffled again: a name given after the window would hide both from Spark."""
    order = Window.partitionBy("rec_id").orderBy(*ORDER)
    return lines(spark, sf_dir).select(
        "rec_id", (F.row_number().over(order) - 1).cast("long").alias("idx"),
        F.col("l_extendedprice").alias("v"), F.round(F.col("l_extendedprice") * 100).alias("c"), F.col("l_quantity").alias("q"), "l_orderkey", "l_partkey", *more)


#: Signals of 20 samples a second: prices as they are, smoothed, or added up, by turns of 150 samples.
SIGNAL_FS = 20.0
SG = f"""{SM}, sg AS (SELECT rec_id, idx, CASE (rec_id + idx // 150) % 3 WHEN 0 THEN c WHEN 1 THEN sum(c) OVER (PARTITION BY rec_id ORDER BY idx ROWS 3 PRECEDING) / 4
  ELSE sum(c) OVER (PARTITION BY rec_id ORDER BY idx) END / 100 AS v FROM sm)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, idx, v."""
    w = Window.partitionBy("rec_id").orderBy("idx")
    turn = F.expr("(rec_id + idx div 150) % 3")
    v = F.when(turn == 0, F.col("c")).when(turn == 1, F.sum("c").over(w.rowsBetween(-3, 0)) / 4).otherwise(F.sum("c").over(w))
    return samples(spark, sf_dir).select("rec_id", "idx", (v / 100).alias("v"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, label, x: arrays of 64 samples."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("rec_id"), "label", F.col("embedding").cast("array<double>").alias("x"))


def frame_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, label, idx (from 0), v."""
    return frames(spark, sf_dir).select("rec_id", "label", F.posexplode("x").alias("idx", "v")).withColumn("idx", F.col("idx").cast("long"))
