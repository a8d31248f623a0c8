"""Streams of log records: appended once each, rolled up by event time.

The batch engine this library mirrors has append-only logs and resume by id only; these are the
same two over Structured Streaming.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_log(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """Stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once_per_key(log: DataFrame, key: str, time: str, late: str = "30 days") -> DataFrame:
    """Every key once, however often it is delivered within the watermark."""
    return log.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed(log: DataFrame, time: str, by: list[str], size: str = "1 day", late: str = "30 days") -> DataFrame:
    """Rows per window of event time and group. A stream has to give a window out at some time, so
    rows later than the watermark are not in it; `counted` has them."""
    return log.withWatermark(time, late).groupBy(F.window(time, size), *by).agg(F.count(F.lit(1)).alias("n"))


def counted(appended: DataFrame, time: str, by: list[str], size: str = "1 day") -> DataFrame:
    """The same counts over the folder `append_pending` fills, read as a table: every key once and
    every row, however late it came. Rows without a time are in no window."""
    return appended.groupBy(F.window(time, size), *by).agg(F.count(F.lit(1)).alias("n"))


def append_pending(log: DataFrame, key: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Start a query that appends to a Parquet folder the records of each batch whose key is not
    there yet: a batch that is run again after a failure adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates([key])
        spark = batch.sparkSession
        hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hp):
            fresh = fresh.join(spark.read.parquet(target).select(key), key, "left_anti")
        transform(fresh).write.mode("append").parquet(target)

    return log.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
