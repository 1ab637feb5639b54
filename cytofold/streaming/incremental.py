"""Incremental aggregation of files as they arrive: an extension, built on Structured Streaming.

Object statistics that merge (counts, sums, sums of squares, extremes) are kept
per cell by a streaming aggregate with a checkpoint, so a restarted run skips
what it has done; late copies of an object are dropped within the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_arrivals(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files below ``path``; the schema is stated, never inferred."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def merged_statistics(stream: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """count, sum, mean, std (sample), min and max by ``keys``."""
    c = F.col(value)
    return stream.groupBy(*keys).agg(F.count(c).alias("count"), F.sum(c).alias("sum"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))


def first_arrivals(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Each key once within ``delay`` of event time; state older than that is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, width: str, delay: str, *keys: str) -> DataFrame:
    """Events and their summed value by time window and keys; windows close ``delay`` after their end."""
    counted = stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), *keys, "n", "total")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; a second run goes on where the first ended."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
