"""The window aggregation on a stream; an extension: its closed windows equal the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_windows(requests: DataFrame, key: str, lateness: str = "2 days", width: str = "5 minutes") -> DataFrame:
    """(key, timestamp, token_load, request_count) per closed window; rows later than `lateness` are dropped by the watermark.

    Works on streams and on tables alike; a TIMESTAMP_NTZ column is taken as UTC.
    """
    return (
        requests.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        .withWatermark("timestamp", lateness)
        .groupBy(key, F.window("timestamp", width).alias("w"))
        .agg(F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("token_load"), F.count(F.lit(1)).alias("request_count"))
        .select(key, F.col("w.start").alias("timestamp"), "token_load", "request_count")
    )


def read_requests(spark, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """A stream over a folder of Parquet files, newest files last."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_once(stream: DataFrame, path: str, checkpoint: str):
    """Writes all closed windows that are there as Parquet and stops; the next call goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
