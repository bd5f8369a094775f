"""Content-addressed blobs: stored by hash, verified when read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def blob_rows(payloads: DataFrame, column: str) -> DataFrame:
    """sha256, relative_path, byte_count, payload: one row for each distinct content."""
    h = F.sha2(F.col(column).cast("binary"), 256)
    rows = payloads.where(F.col(column).isNotNull()).select(h.alias("sha256"), F.concat_ws("/", F.substring(h, 1, 2), F.substring(h, 3, 2), h).alias("relative_path"), F.octet_length(column).cast("long").alias("byte_count"), F.col(column).cast("binary").alias("payload"))
    return rows.dropDuplicates(["sha256"])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as blobs, with whether name and content agree."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    h = F.sha2("content", 256)
    return found.select("path", "length", h.alias("sha256"), (F.element_at(F.split("path", "/"), -1) == h).alias("is_valid"))
