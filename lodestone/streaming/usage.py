"""An extension: usage roll-ups over a stream of log files, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def usage_stream(spark: SparkSession, path: str, schema, late: str = "1 hour") -> DataFrame:
    """Counts by hour and event type; an hour is final once the watermark has passed it."""
    rows = spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("hour"), "event_type", "n")


def roll_up(spark: SparkSession, path: str, schema, out: str, checkpoint: str) -> None:
    """Work off what has arrived; a later call goes on from the checkpoint."""
    usage_stream(spark, path, schema).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
