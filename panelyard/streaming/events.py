"""Structured Streaming counterparts: windowed aggregates with a watermark, deduplication, and a sink per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, glob: str = "events.parquet", files_per_trigger: int = 1) -> DataFrame:
    schema = spark.read.parquet(f"{path}/{glob}").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(stream: DataFrame, length: str = "30 days", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Counts and sums by event type in event-time windows; rows later than ``late`` are dropped by the watermark."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(stream: DataFrame, keys: list[str], late: str = "2 days") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def append_batches(stream: DataFrame, path: str, checkpoint: str):
    """Appends each micro-batch as Parquet; a batch that is run again replaces itself, by its number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
