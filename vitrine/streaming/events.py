"""Event streams: windows and sessions with watermarks, removal of repeats, and change feeds into tables.

Every function takes a streaming DataFrame and gives one, or writes one to a folder in batches that may be
repeated without harm. ``finished`` runs what is there now and ends, for jobs that run on a schedule.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators.sequences import latest


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a Parquet table, and of files that come to it later, as a stream."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}*")


def windowed(stream: DataFrame, ts: str, keys: list[str], measures: dict[str, Column], size: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Measures by window and keys; a window is given out once, when the watermark has passed its end. Rows
    that come later than ``delay`` after the latest one are left out."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = stream.withWatermark(ts, delay).groupBy(window.alias("window"), *keys).agg(*(m.alias(n) for n, m in measures.items()))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *measures)


def latencies(stream: DataFrame, ts: str, key: str, value: str, edges: list[float], size: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """Counts by window, key and bucket of a measure (the least edge that is not below it; the last takes the
    rest): a running histogram whose percentiles are read off later, with state bounded by the buckets."""
    bucket = F.coalesce(*(F.when(F.col(value) <= e, F.lit(float(e))) for e in edges), F.lit(float(edges[-1])))
    rows = stream.where(F.col(value).isNotNull()).withColumn("bucket", bucket)
    return windowed(rows, ts, [key, "bucket"], {"n": F.count("*")}, size, delay=delay)


def sessions(stream: DataFrame, ts: str, key: str, measures: dict[str, Column], gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Measures by key and session; a session ends when nothing came for ``gap``."""
    out = stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("window"), key).agg(*(m.alias(n) for n, m in measures.items()))
    return out.select(key, F.col("window.start").alias("started"), F.col("window.end").alias("closed"), *measures)


def without_repeats(stream: DataFrame, ts: str, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """The first row of each key; keys are forgotten after ``delay``, so state stays bounded."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def folders(spark: SparkSession, what: str) -> tuple[str, str]:
    """A new folder for a stream's rows and one for its progress, both shared by driver and executors."""
    from vitrine.operators.hierarchy import shared_dir

    base = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    return f"{base}/rows", f"{base}/progress"


def finished(stream: DataFrame, what: str = "stream", to: str | None = None, progress: str | None = None) -> DataFrame:
    """Runs a stream over all that is there now, appends its rows to a Parquet folder and gives that folder's
    rows. With the same folders again it goes on where it ended."""
    spark = stream.sparkSession
    rows, done = folders(spark, what)
    rows, done = to or rows, progress or done
    query = stream.writeStream.format("parquet").outputMode("append").option("path", rows).option("checkpointLocation", done).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(rows)


def applied(stream: DataFrame, key: str, order: list[str], to: str, progress: str) -> None:
    """Writes a change feed to a log, each batch's last change by key in a folder of its own: a repeated batch
    overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, key, order).write.mode("overwrite").parquet(f"{to}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, log: str, key: str, order: list[str], deleted: str | None = None) -> DataFrame:
    """The table that a log of changes amounts to: the last row of each key, unless it says that the key is gone."""
    rows = latest(spark.read.parquet(log).drop("batch"), key, order)
    return rows.where(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else rows
