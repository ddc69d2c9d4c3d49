"""Streams of files: the same row-wise transforms, appended logs, and windows of time."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.operators.analytics import month_of


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir; only where none is named, of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spanloom-")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def read_files(spark: SparkSession, path: str, schema, files_per_batch: int = 100, names: str = "*.parquet") -> DataFrame:
    """A stream of the Parquet files that appear below path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", names).parquet(path)


def run_to_end(rows: DataFrame, out: str, checkpoint: str, *partitions: str) -> StreamingQuery:
    """Appends a stream's rows below out until there is no new input; started again, it goes on where it ended."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True)
    query = (writer.partitionBy(*partitions) if partitions else writer).start()
    query.awaitTermination()
    return query


def pseudonymise_stream(rows: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """transform, which may aggregate by document, on each batch of new documents."""

    def batch(df: DataFrame, epoch: int) -> None:
        transform(df).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def log_stream(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """New log rows, appended by month."""
    return run_to_end(events.withColumn("month", month_of(F.col("ts"))), out, checkpoint, "month")


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """Counts by type in tumbling windows; rows later than the watermark are dropped, and a window is given out once it is past it. An addition of this library."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "7 days") -> DataFrame:
    """A user's sessions: events with less than a gap between them. An addition of this library."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
