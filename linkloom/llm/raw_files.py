"""Binary files through Spark's own writer, so that any file system Spark knows will do and a lost task is just rerun.

A column of byte strings goes out by the text writer, which copies bytes as they are. The line separator is MARK, eight
ASCII bytes that form an empty Zstandard skippable frame, so a file of Zstandard frames stays a valid stream. Each task
writes one file, with its rows in order; or, with rows_per_file, as many as it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = b"P*M\x18\0\0\0\0"


def write_raw(df: DataFrame, column: str, path: str, rows_per_file: int = 0) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.option("lineSep", MARK.decode()).option("maxRecordsPerFile", rows_per_file).text(path)


def read_raw(spark, path: str) -> DataFrame:
    """path and content of each file written by write_raw."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
