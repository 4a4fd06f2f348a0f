"""Streams over landed files: windows over the event log, and new text files as they land. These go beyond the batch engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.functions.texts import clean_document_text


def event_stream(spark: SparkSession, directory: str, schema: str) -> DataFrame:
    """Parquet files landing in a directory, read once each."""
    return spark.readStream.schema(schema).parquet(directory)


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows and total per event type and window; rows later than `late` behind the newest are left out."""
    span = F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("hour"), "n", "total")


def landed_texts(spark: SparkSession, directory: str) -> DataFrame:
    """path and cleaned text of the UTF-8 .txt files as they land."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.txt").load(directory)
    return files.select("path", clean_document_text(F.decode("content", "UTF-8")).alias("text"))
