"""Images decoded as they arrive in a folder, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.disc import Options, decode


def stream(spark: SparkSession, path: str, what: str, options: Options | None = None) -> DataFrame:
    """The table ``what`` of each new image below ``path``; each file is decoded once."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(path)
    return decode(files, what, options)
