"""The change feed as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.schemas import EVENTS


def read_feed(
    spark: SparkSession, path: str, file_format: str = "json", max_files: int | None = None
) -> DataFrame:
    """(seq, payload) from the files that arrive in ``path``."""
    reader = spark.readStream.format(file_format).schema(EVENTS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)
