"""Incremental scans as streams: new rows only, merged into a table; windows over events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.merge import delete_keys


def table_exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def scan_incrementally(source: DataFrame, key: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append the rows of a streaming ``source`` whose key the table at ``target`` lacks.

    Each micro-batch is an anti-join with the table, so files that come twice, rows
    that repeat and a stream that starts again from nothing are stored once. Every
    start has folders of its own: a batch that is done again finds its rows stored,
    or writes over what it left unfinished, and never over rows of an earlier start.
    """
    run = uuid.uuid4().hex

    def write(batch: DataFrame, number: int) -> None:
        spark, own = batch.sparkSession, f"{run}-{number}"
        rows = batch.dropDuplicates([key])
        if table_exists(spark, target):
            stored = T.StructType([batch.schema[key], T.StructField("batch", T.StringType())])
            known = spark.read.schema(stored).option("basePath", target).parquet(target)
            rows = delete_keys(rows, known.where(F.col("batch") != own), [key])
        rows.write.mode("overwrite").parquet(f"{target}/batch={own}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, length: str, lateness: str) -> DataFrame:
    """Counts and sums per window and type of an event stream (or table) with a watermark."""
    return (
        events.withWatermark("ts", lateness)
        .groupBy(F.window("ts", length).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def sessions(events: DataFrame, gap: str, lateness: str) -> DataFrame:
    """Sessions of each user: events no more than ``gap`` apart."""
    return (
        events.withWatermark("ts", lateness)
        .groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count("*").alias("n"))
        .select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )
