"""Incremental registration: every catalogue file once, as a file stream that ends when all are done."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import CATALOGUE


def ingest_new_files(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Songs of files that no earlier run has read are appended to target, with their file's name."""
    docs = spark.readStream.schema(CATALOGUE).option("multiLine", True).json(folder)
    songs = docs.select(F.col("_metadata.file_name").alias("source_file"), F.explode("songs").alias("s")).select("source_file", "s.id", "s.title", "s.duration")
    return songs.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
