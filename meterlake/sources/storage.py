"""Readers, sinks and the shared scratch folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@functools.cache
def _local_base() -> str:
    return tempfile.mkdtemp(prefix="meterlake-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; a local session without it uses a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_base()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once and read it back: later passes and lost executors never repeat the work before it."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(model, name: str):
    """A fitted model as saved and loaded again: without its training summary, which ties it to the fitting session."""
    path = shared_folder(SparkSession.active(), name)
    model.write().save(path)
    return type(model).load(path)


def trim_range(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Rows with start <= column < end, after windows have used what lies before."""
    return df.where((F.col(column) >= F.lit(start).cast("timestamp")) & (F.col(column) < F.lit(end).cast("timestamp")))


def read_dates(
    spark: SparkSession, path: str, column: str, start: str | None = None, end: str | None = None, date_column: str = "date"
) -> DataFrame:
    """A date-partitioned table, over [start, end) if given: the date filter prunes folders, the time filter row groups."""
    if start is None or end is None:
        return spark.read.parquet(path)
    low, high = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    rows = spark.read.parquet(path).where(F.col(date_column).between(low.cast("date"), high.cast("date")))
    return rows.where((F.col(column) >= low) & (F.col(column) < high))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with header and declared schema; a missing path gives no rows. A byte-order mark is skipped by Spark."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def lenient_double(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))


def lenient_int(c: Column, default: int = 0) -> Column:
    """Number text truncated towards zero, as an int; anything else gives the default."""
    return F.coalesce(c.try_cast("double").try_cast("bigint"), F.lit(default))


def lenient_timestamp(c: Column, default: str) -> Column:
    formats = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
    tries = [F.try_to_timestamp(c, F.lit(f)) for f in formats]
    return F.coalesce(*tries, c.try_cast("timestamp"), F.lit(default).cast("timestamp"))


def append_by_date(df: DataFrame, path: str, date_column: str = "date") -> int:
    """Append partitioned by date and return the rows written, counted in the same pass.

    Rows of one date may be most of a load: the write keeps the frame's partitions and adds no shuffle on date.
    """
    seen = Observation()
    (
        df.observe(seen, F.count(F.lit(1)).alias("rows"))
        .write.mode("append")
        .partitionBy(date_column)
        .parquet(path)
    )
    return seen.get["rows"]


def overwrite_dates(df: DataFrame, path: str, date_column: str = "date") -> None:
    """Replace only the dates present in the frame, so that a repeated run leaves the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date_column).parquet(path)


def write_top(df: DataFrame, path: str, order: list[Column], rows: int) -> None:
    """Best ``rows`` rows as CSV (a ranked artifact)."""
    df.orderBy(*order).limit(rows).write.mode("overwrite").option("header", True).csv(path)
