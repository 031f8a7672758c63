"""Tables kept between steps, always in a folder every executor can reach."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting, as in tests, gets a temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _local:
        _local[context.applicationId] = tempfile.mkdtemp(prefix="lexloom-")
    return _local[context.applicationId]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables made inside go to a folder that is deleted at the end.

    Store the results before: they read these tables.
    """
    folder = f"{shared_folder(spark)}/lexloom-scratch-{uuid.uuid4().hex}"
    token = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(token)
        context = spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession, name: str = "table") -> str:
    """A fresh path inside the scratch folder, or else the shared one."""
    return f"{_scratch.get() or shared_folder(spark)}/lexloom-{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
    """Write a DataFrame once and read it back.

    Later plans then start from a Parquet scan whose size is known, and a lost
    executor costs a re-read instead of the whole lineage.
    """
    spark = df.sparkSession
    path = path or new_folder(spark, name)
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    stored = spark.read.schema(schema).parquet(path)
    stored._kept_in = path
    return stored


def kept_outside(df: DataFrame, columns: list[str], path: str) -> bool:
    """Whether a DataFrame is just what ``keep`` returned, with these columns, from outside a folder."""
    own = getattr(df, "_kept_in", None) if "_kept_in" in vars(df) else None
    return own is not None and df.columns == columns and not f"{own}/".startswith(f"{path.rstrip('/')}/")
