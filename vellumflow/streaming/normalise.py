"""The normalisation rules over streams: stateless, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellumflow.functions.text import is_blank, normalize


def read_text_stream(spark: SparkSession, path: str, schema, *, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def normalise_stream(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows that aren't blank, with normalized and changed."""
    rows = stream.filter(~is_blank(F.col(text_col))).withColumn("normalized", normalize(F.col(text_col)))
    return rows.withColumn("changed", F.col(text_col) != F.col("normalized"))


def windowed_changes(stream: DataFrame, time_col: str, *, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Changed rows per time window; rows later than ``late`` are left out."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, window)).agg(F.count("*").alias("n"), F.count_if("changed").alias("n_changed"))


def write_stream(stream: DataFrame, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
