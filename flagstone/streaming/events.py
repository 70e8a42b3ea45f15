"""Dropped event files as a stream.

The row-wise operators (columns, tokens, encoding, scorecard, batch scoring) take the stream
unchanged. They hold no state, so no watermark is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from flagstone.sources.events import TIME_FORMAT


def stream_events(spark: SparkSession, folder: str, schema: StructType | str, max_files: int = 1000) -> DataFrame:
    """CSV files with a header, read once each as they arrive in `folder`."""
    reader = spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", max_files)
    return reader.option("mode", "FAILFAST").option("timestampNTZFormat", TIME_FORMAT).csv(folder)


def write_stream(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append to Parquet exactly once; by default process what has arrived and stop."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).outputMode("append").start()
