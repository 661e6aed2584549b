"""Incremental forms of the batch operators for feeds that arrive in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def file_feed(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def first_deliveries(feed: DataFrame, keys: list[str], event_time: str, late: str) -> DataFrame:
    """Each key once; state is dropped when the watermark has passed, so redeliveries later than ``late`` count anew."""
    return feed.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(feed: DataFrame, event_time: str, keys: list[str], width: str, slide: str, late: str, measure: str) -> DataFrame:
    """Count, sum and mean per sliding window and key; rows later than the watermark are left out."""
    w = F.window(event_time, width, slide)
    out = feed.withWatermark(event_time, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(measure).alias("total"), F.avg(measure).alias("mean"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total", "mean")


def append_parquet(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once file sink over everything that is there now."""
    return df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
