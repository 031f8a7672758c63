"""Stored lexicons: a folder of Parquet tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexloom.languages import features_for, metadata_for

TABLES = ["lexicon", "wide", "features", "feature_values", "lemmaforms", "forms", "lemmas",
          "init_grams", "fin_grams", "bigrams", "word_bigrams", "totals", "metadata"]

# Tables with the lexicon's content; ``wide`` is the search copy of it.
EXPORTED = [name for name in TABLES if name != "wide"]

# Stands beside the tables once all of them are written.
MARK = "_complete"

# What is read when a lexicon is opened.
METADATA_KEYS = list(metadata_for("fi"))
TOTAL_NAMES = ["frequency", "lemmafreq", "initgramfreq", "fingramfreq", "bigramfreq"]


def _path(spark: SparkSession, path: str):
    """A Hadoop path and its file system: a lexicon may lie in any store that Spark reads."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(context._jsc.hadoopConfiguration())


def begin(spark: SparkSession, path: str) -> None:
    """Take the completion mark away: from here on the tables may be old, new or missing.

    Indexes of the tables lose theirs too.
    """
    for folder in (f"{path}/indexes", path):
        mark, files = _path(spark, f"{folder}/{MARK}")
        files.delete(mark, False)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a folder has its completion mark."""
    mark, files = _path(spark, f"{path}/{MARK}")
    return files.exists(mark)


def complete(spark: SparkSession, path: str) -> None:
    """Set the completion mark, after the last table."""
    mark, files = _path(spark, f"{path}/{MARK}")
    files.create(mark, True).close()


@dataclass
class Lexicon:
    """A stored lexicon: its tables, metadata and corpus totals."""

    path: str
    tables: dict[str, DataFrame]
    metadata: dict[str, str]
    totals: dict[str, int]
    features: dict[str, str] = field(init=False)
    #: Search indexes (``plans.indexes``), if it was opened with them.
    indexes: Any = None

    def __post_init__(self) -> None:
        self.features = features_for(self.metadata.get("langcode"))

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Lexicon":
        """Open a stored lexicon; only its few metadata and total rows are read.

        One whose build did not come to its end is refused.
        """
        if not finished(spark, path):
            raise ValueError(f"no finished lexicon in {path}: it is missing, or a build was interrupted")
        tables = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
        # Only the keys the library uses come to the driver, whatever else is stored.
        metadata = {row.key: row.value for row in
                    tables["metadata"].where(F.col("key").isin(METADATA_KEYS)).distinct().collect()}
        totals = {row.name: row.total for row in
                  tables["totals"].where(F.col("name").isin(TOTAL_NAMES)).distinct().collect()}
        missing = sorted({"langcode", *TOTAL_NAMES} - set(metadata) - set(totals))
        if missing:
            raise ValueError(f"the lexicon in {path} lacks {', '.join(missing)}")
        return cls(path, tables, metadata, totals)
