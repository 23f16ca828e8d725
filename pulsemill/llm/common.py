"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import functools
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text handed to a Python worker at once; keeps a worker's memory small when texts are long.
ARROW_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the Arrow batch size to ARROW_ROWS unless the session already asks for less. It stays lowered: a plan reads it when it
    runs, which is after the query that made it has returned."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """At most so many rows in an Arrow batch, for what runs inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where none is set and all executors are on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (path or _own_dir()).rstrip("/")


@functools.cache
def _own_dir() -> str:
    at = tempfile.mkdtemp(prefix="pulsemill-")
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    return at


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back with its own schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a materialize() result that no later plan reads."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


#: Bits that a bitmap has for each of its hashes, at least, and the least and most bits of one as powers of two: 16 MB at most.
BITS_EACH, BITMAP = 16, (15, 27)


def parted(df: DataFrame, of: Column, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose hash `of` (long) may be one of the hashes (one long column, read twice), and those whose hash is none of
    them. A broadcast bitmap of bounded size tells them apart, so that no row of df is shuffled; a part that it passes in vain only
    makes the first one larger."""
    least, most = BITMAP
    bits = min(most, max(least, (BITS_EACH * hashes.count()).bit_length()))
    at = lambda h: h.bitwiseAND((1 << bits) - 1)
    place = F.col(hashes.columns[0])
    made = hashes.groupBy(F.shiftright(at(place), least).alias("bucket")).agg(F.bitmap_construct_agg(at(place).bitwiseAND((1 << least) - 1)).alias("bits"))
    both = df.join(F.broadcast(made), F.shiftright(at(of), least) == made["bucket"], "left")
    byte = F.conv(F.hex(F.substring(made["bits"], (F.shiftright(at(of).bitwiseAND((1 << least) - 1), 3) + 1).cast("int"), F.lit(1))), 16, 10)
    marked = F.coalesce(F.getbit(byte.cast("long"), at(of).bitwiseAND(7).cast("int")) == 1, F.lit(False))
    own = [df[c] for c in df.columns]
    return both.where(marked).select(*own), both.where(~marked).select(*own)


def keyed(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, text and th, the 64-bit hash of the text: (doc_id, th) names a row, so that rows which
    repeat a doc_id with another text stay apart and rows that repeat both share one result."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))


def same_doc(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def binary(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
