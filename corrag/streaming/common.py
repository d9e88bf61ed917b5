"""Shared pieces of the streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def stream_table(spark: SparkSession, folder: str, pattern: str, schema: T.StructType) -> DataFrame:
    """New parquet files of ``folder`` that match ``pattern``, as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table as a stream, whether ``path`` is one file or a folder of files.

    Braces make the path a pattern: a stream takes a plain path for a folder only.
    """
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).parquet(f"{folder}/{{{name}}}")


def append_to(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append finished rows to a parquet table, exactly once."""
    writer = (stream.writeStream.format("parquet").outputMode("append")
              .option("path", path).option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
