"""Structured Streaming over a folder of recordings: each new file's headers and annotations as rows.

A file source lists new files exactly once (its log is the checkpoint); each micro-batch reads
them through the edf source, so a batch has the same rows as a batch job over the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.operators.events import annotations
from tracelode.sources.edf import read_edf


def arriving_files(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """path, modified and size of files as they arrive; contents aren't read."""
    stream = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.edf").option("maxFilesPerTrigger", files_per_batch)
    schema = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
    return stream.schema(schema).load(folder).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def local_path(uri: str) -> str:
    """A path without the scheme of local files, whose slashes may be one or three; other URIs stay as they are."""
    return "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri


def each_batch(handle, view: str = "annotations"):
    """A foreachBatch function that reads a batch's files as a view and hands them to ``handle(df, batch_id)``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        # Bounded by files_per_batch.
        paths = sorted(local_path(r.path) for r in batch.select("path").distinct().collect())
        if paths:
            spark = batch.sparkSession
            handle(annotations(read_edf(spark, paths, "tals")) if view == "annotations" else read_edf(spark, paths, view), batch_id)

    return run
