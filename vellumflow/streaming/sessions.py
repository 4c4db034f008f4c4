"""Sessions of events as a stream: repeated events dropped, late ones left out, closed sessions written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumflow.sources.scratch import scratch_path


def sessions(stream: DataFrame, *, key: str = "user_id", time_col: str = "ts", event_id: str = "event_id", value: str = "value", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """key, first_at, ends_at, n, total of each session: events of a key less than ``gap`` apart.

    Both steps keep state: an event's id for ``late`` after it, and sessions until the
    watermark, the latest time less ``late``, has passed their end. Events older than
    the watermark that the batch before closed sessions by are left out.
    """
    timed = stream.withColumn(time_col, F.col(time_col).cast("timestamp"))
    fresh = timed.withWatermark(time_col, late).dropDuplicatesWithinWatermark([event_id])
    grouped = fresh.groupBy(F.session_window(time_col, gap).alias("w"), F.col(key)).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return grouped.select(key, F.col("w.start").alias("first_at"), F.col("w.end").alias("ends_at"), "n", "total")


def closed_sessions(spark: SparkSession, path: str, *, files: int = 1000, **how) -> DataFrame:
    """The sessions that are closed once all that lies at ``path`` has been read as a stream, ``files`` at a time; a single file is named by a pattern."""
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)
    out = scratch_path(spark, "sessions")
    found = sessions(stream, **how)
    query = found.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{out}/rows")
