"""Typed word lists: ``# type = form|lemma|nonword`` and one item per line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lexloom.operators.lookup import lookup_join
from lexloom.sources.text import scan, with_row_ids
from lexloom.storage import keep

# The list types.
TYPES = ("lemma", "form", "nonword")


def read_wordlist(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, type, item, position): the items of each list, numbered from 1.

    The first header with a known type counts. Items before it, other lines with a
    ``#`` in front and blank lines are skipped. A file that is not valid UTF-8 is
    read as Latin-1; a byte order mark is dropped.
    """
    raw = with_row_ids(scan(spark, path))
    encoding = raw.groupBy("file").agg(F.every(F.is_valid_utf8("value")).alias("utf8"))
    raw = lookup_join(raw, keep(encoding, "encodings"), ["file"])
    latin1 = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    text = F.when(F.col("utf8"), F.col("value")).otherwise(latin1)
    # Stored once, so that header and items are judged by the same line numbers.
    lines = keep(raw.select("file", "block", "row_id",
                            F.regexp_replace(text, "^\\uFEFF", "").alias("line")), "lines")
    comment = F.startswith("line", F.lit("#"))
    kind = F.regexp_extract("line", r".*type\s*=\s*(\w+)", 1)

    headers = (lines.where(comment & kind.isin(*TYPES))
               .groupBy("file")
               .agg(F.min_by(F.struct("block", "row_id", kind.alias("type")),
                             F.struct("block", "row_id")).alias("header")))
    items = lookup_join(lines.where(~comment & (F.trim("line") != "")),
                        keep(headers, "headers"), ["file"], "inner")
    after = F.struct("block", "row_id") > F.struct("header.block", "header.row_id")
    kept = keep(items.where(after).select(
        "file", "block", "row_id", F.col("header.type").alias("type"),
        F.regexp_replace("line", r"^\s+|\s+$", "").alias("item")), "items")
    return _numbered(kept)


def _numbered(items: DataFrame) -> DataFrame:
    """Items by their place in the file.

    A stored list keeps its split and line order; each split is numbered by itself
    and shifted by the splits before it.
    """
    in_block = Window.partitionBy("file", "block").orderBy("row_id")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (items.groupBy("file", "block").agg(F.count("*").alias("n"))
              .select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    placed = items.withColumn("at", F.row_number().over(in_block))
    return placed.join(starts, ["file", "block"]).select(
        "file", "type", "item", (F.col("start") + F.col("at")).cast("int").alias("position"))
