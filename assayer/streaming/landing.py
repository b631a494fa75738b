"""Extension: documents that land in a folder as a stream, and latency over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.uploads import document_hash, sanitize_filename, upload_error


def landed(spark: SparkSession, path: str, max_bytes: int) -> DataFrame:
    """Valid new files of a folder, each content once."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    named = raw.select(sanitize_filename(F.col("path")).alias("source_doc"), "content", document_hash(F.col("content")).alias("document_hash"), upload_error(F.col("path"), F.col("content"), max_bytes).alias("error_code"))
    return named.filter("error_code is null").drop("error_code").dropDuplicates(["document_hash"])


def latency_windows(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, mean and largest value by event type and window; events later than `late` are left out of a stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    w = rows.groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.max("value").alias("max_value"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "mean_value", "max_value")
