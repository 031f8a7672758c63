"""Tables kept between the steps of an operator, in the folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """A new folder under ``spark.checkpoint.dir`` for the tables of one operator.

    Steps write a table and read it back, so a lost executor costs a re-read. ``close``
    deletes the folder; call it when results that were read from it are stored. Only a
    session without that setting, as in tests, gets a temporary folder.
    """

    def __init__(self, spark: SparkSession, name: str = "work", folder: str | None = None):
        folder = folder or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
            folder = tempfile.mkdtemp(prefix="llm-")
        self.spark = spark
        self.folder = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        """A path inside the folder that nothing else uses."""
        return f"{self.folder}/{name}-{uuid.uuid4().hex[:12]}"

    def keep(self, df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
        """Write a DataFrame and read it back.

        What was shuffled for it is deleted once it is written, as the table is read from then on. Otherwise
        the disk would hold the shuffles of all steps until the driver happens to collect garbage.
        """
        path, schema = path or self.path(name), df.schema
        before = self.spark.conf.get(_CLEAN, None)
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(_CLEAN)
            else:
                self.spark.conf.set(_CLEAN, before)
        stored = self.spark.read.schema(schema).parquet(path)
        stored._stored_at = path
        return stored

    def close(self) -> None:
        """Delete the folder."""
        self.drop(self.folder)

    def forget(self, *tables: DataFrame) -> None:
        """Delete tables that ``keep`` returned and that nothing reads any more."""
        for kept in tables:
            self.drop(kept._stored_at)

    def drop(self, path: str) -> None:
        """Delete a table that nothing reads any more."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def carried(docs: DataFrame) -> tuple[list[Column], list[Column]]:
    """The columns of ``docs`` by numbered names, ``_c0`` onwards, and by their own again.

    Operators that return rows as given carry them so, and no column can clash with an inner name.
    """
    there = [F.col("`" + name.replace("`", "``") + "`").alias(f"_c{i}") for i, name in enumerate(docs.columns)]
    return there, [F.col(f"_c{i}").alias(name) for i, name in enumerate(docs.columns)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
