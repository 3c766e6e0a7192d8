"""The same findings and counts over streams. Findings need no state; windows are bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.surface import surface_findings


def document_stream(spark: SparkSession, path: str) -> DataFrame:
    """Documents (doc_id, text) of Parquet files as they arrive in a folder."""
    return spark.readStream.schema("doc_id long, text string").parquet(path)


def finding_stream(docs: DataFrame) -> DataFrame:
    return surface_findings(docs)


def event_windows(events: DataFrame, length: str = "60 seconds", late: str = "5 minutes") -> DataFrame:
    """Events (user_id, ts) by user and window; rows later than ``late`` are not counted."""
    counts = events.withWatermark("ts", late).groupBy("user_id", F.window("ts", length).alias("w")).agg(F.count("*").alias("n"))
    return counts.select("user_id", F.col("w.start").alias("window_start"), "n")


def run_available(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Process what has arrived, append it to Parquet at ``path`` and stop."""
    rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start().awaitTermination()
