"""Streams of events: sessions with a gap, and audit lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Sessions of each user: events less than gap apart.  Works on batches and, with the watermark, on streams."""
    if events.isStreaming:
        events = events.withWatermark("ts", watermark)
    out = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n_events"))
    return out.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n_events")


def event_stream(spark: SparkSession, path: str, files_each: int | None = None) -> DataFrame:
    """Event files, Parquet, as a stream; oldest files first, files_each at most in a batch.  Times are those of the session's zone."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    # a pattern may match one file, which a plain path of a stream must not be
    rows = (reader.option("maxFilesPerTrigger", files_each) if files_each else reader).parquet(f"{path[:-1]}[{path[-1]}]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def append_sessions(events: DataFrame, path: str, checkpoint: str, gap: str = "30 minutes", watermark: str = "1 hour") -> StreamingQuery:
    """Start appending closed sessions to the Parquet table at path, with what is there now, then stop.

    A session is closed, and written once, when the watermark (latest event less the delay) has passed its end.  An event that
    comes when the watermark has already passed the end of its own gap is late and dropped.  Open sessions wait in
    the checkpoint: the next start goes on from there, and reads only files that are new.
    """
    writer = sessions(events, gap, watermark).writeStream.outputMode("append").format("parquet")
    return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def closed_sessions(spark: SparkSession, path: str, out: str, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Run the event files at path through append_sessions(); what it wrote to out/sessions so far."""
    query = append_sessions(event_stream(spark, path), f"{out}/sessions", f"{out}/state", gap, watermark)
    query.awaitTermination()
    return spark.read.schema("user_id long, session_start timestamp, session_end timestamp, n_events long").parquet(f"{out}/sessions")
