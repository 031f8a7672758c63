"""Shared parts of the text scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

TOKEN_COLUMNS = ["file", "sent_id", "token_id", "form", "lemma", "upos", "feats"]


def scan(spark: SparkSession, paths: str | Sequence[str], line_sep: str | None = None,
         glob: str | None = None) -> DataFrame:
    """Text records with their file, input split and order: (file, block, row_id, value)."""
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if line_sep:
        reader = reader.option("lineSep", line_sep)
    paths = [paths] if isinstance(paths, str) else list(paths)
    return reader.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        "value")


def with_row_ids(rows: DataFrame) -> DataFrame:
    """Number the records of a scan in their order; the order holds inside a file."""
    return rows.withColumn("row_id", F.monotonically_increasing_id())


def first_paths(spark: SparkSession, path: str, glob: str, count: int) -> list[str]:
    """The first ``count`` matching files under a path, by name; contents are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", glob).load(path).select("path"))
    return [row.path for row in files.orderBy("path").limit(count).collect()]

