"""Changed files as a stream: a poll of a folder that yields each new content once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def changed_files(spark: SparkSession, path: str, delay: str = "1 day") -> DataFrame:
    """Streaming (path, sha256, modificationTime): a row whenever a file appears or changes its content. The watermark bounds the hashes that are remembered to those of the last `delay`."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    marked = files.select("path", "modificationTime", F.sha2("content", 256).alias("sha256")).withWatermark("modificationTime", delay)
    return marked.dropDuplicatesWithinWatermark(["path", "sha256"])
