"""Departure counts in hourly windows as a stream; the batch models' time bins, kept up to date."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """events (ts, event_type), batch or stream -> start, event_type, n. Watermarks need a timestamp with a zone."""
    at = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = at.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n")


def leaf_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events of a folder's events.parquet as a stream, be it a file or a folder of files."""
    from skylattice.sources import storage

    path = f"{folder}/events.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    return source.parquet(path) if storage.is_folder(spark, path) else source.option("pathGlobFilter", "events.parquet").parquet(folder)


def closed(spark: SparkSession, folder: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """The windows that the watermark has closed, each written once: append mode into files of the shared folder, exactly once by
    the stream's checkpoint. Rows that come later than their window was closed don't count."""
    from skylattice.session import shared_folder

    at = f"{shared_folder(spark)}/rates-{uuid.uuid4().hex}"
    stream = windowed(leaf_stream(spark, folder), late, width).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{at}/_checkpoint").trigger(availableNow=True).start(f"{at}/windows")
    stream.awaitTermination()
    rows = spark.read.schema("start timestamp, event_type string, n long").parquet(f"{at}/windows")
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    """All of a folder's events through the stream at once, in complete mode, as a table."""
    source = leaf_stream(spark, folder)
    name = f"rates_{uuid.uuid4().hex}"
    stream = windowed(source).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.table(name).withColumn("start", F.col("start").cast("timestamp_ntz"))
