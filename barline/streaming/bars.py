"""Hourly bars of an event stream, closed by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_bars(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """hour, ticker, open, high, low, close, volume. Works on streams and tables alike; on a stream, a bar is out once
    the watermark has passed it. Events at one instant are in order of id."""
    order = F.struct(F.col("_ts"), F.col("event_id"))
    placed = events.withColumn("_ts", F.col("ts").cast("timestamp")).withWatermark("_ts", late)
    bars = placed.groupBy(F.window("_ts", width).alias("w"), F.col("event_type").alias("ticker")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return bars.select(F.col("w.start").alias("hour"), "ticker", "open", "high", "low", "close", "volume")


def run_hourly(spark, path: str, checkpoint: str, table: str, late: str = "10 minutes") -> None:
    """Reads what is at path as a stream, once, and leaves the closed bars in a memory table."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(path)
    query = hourly_bars(stream, late).writeStream.format("memory").queryName(table).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
