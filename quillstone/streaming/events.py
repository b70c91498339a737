"""Streams of events: windows, sessions, rows sent twice, and what is known of them. Extensions: most plans run over tables, too."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators.lineage import prepare

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their values by window and kind; later ones than the watermark allows are left out in a stream."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, last_end, n, total): a user's events with less than a gap between any two; the end is a gap after
    the last. A stream gives a session when its watermark has passed that end, and drops rows that come later."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    grouped = timed.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return grouped.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("last_end"), "n", "total")


def sent_once(events: DataFrame, key: list[str], late: str = "10 minutes") -> DataFrame:
    """The rows of a stream without those whose key has come before, if not longer ago than the watermark allows. Keys are
    held no longer than that."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.dropDuplicatesWithinWatermark(key).drop("at")


def enriched(events: DataFrame, known: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Each event with what a table says of it, null where it says nothing: the stream keeps no state for that."""
    return events.join(known.select(on, *columns), on, "left")


def read_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet", files_at_once: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(SCHEMA).option("pathGlobFilter", pattern)
    return (reader if files_at_once is None else reader.option("maxFilesPerTrigger", files_at_once)).parquet(folder)


def collected(flow: DataFrame, folder: str | None = None) -> DataFrame:
    """Runs a stream over what is there now, to the end, and gives the rows that it has appended to Parquet files.

    With a folder, a later call goes on from where this one ended; without, it is one of its own in the shared folder.
    """
    spark = flow.sparkSession
    if folder is None:
        prepare(spark)
        folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid4().hex}"
    run = flow.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows")
    run.awaitTermination()
    return spark.read.schema(flow.schema).parquet(f"{folder}/rows")


def run_once(spark: SparkSession, folder: str, name: str, checkpoint: str, pattern: str = "events*.parquet") -> DataFrame:
    """Reads what is there now, to the end, into a table in memory."""
    flow = windowed(read_stream(spark, folder, pattern)).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    flow.awaitTermination()
    return spark.table(name)
