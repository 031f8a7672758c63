"""CoNLL-U scan, plain or gzip: a file, a list of files or a directory tree."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexloom.operators.lookup import numbered_lines
from lexloom.sources.text import TOKEN_COLUMNS, first_paths, scan

GLOB = "*conllu{,.gz}"

# The ten columns of the format.
COLUMNS = ["token_id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc"]
TOKEN_FIELDS = ["token_id", "form", "lemma", "upos", "feats"]


def _tokens(rows: DataFrame, *extra: str) -> DataFrame:
    """Token columns; runs of spaces become one, range lines such as ``1-2`` are left out."""
    def text(name: str) -> Column:
        spaced = F.contains(name, F.lit("  "))
        return F.when(spaced, F.regexp_replace(name, " +", " ")).otherwise(F.col(name)).alias(name)

    rows = rows.where(~F.contains("token_id", F.lit("-")))
    return rows.select(*extra, "token_id", text("form"), text("lemma"), "upos",
                       F.coalesce("feats", F.lit("_")).alias("feats"))


def read_conllu(spark: SparkSession, path: str | Sequence[str], file_cap: int | None = None,
                sentence_cap: int | None = None, glob: str = GLOB) -> DataFrame:
    """Tokens with the number of their sentence in the file.

    Any line end is fine, and any number of blank lines between sentences. ``file_cap``
    reads the first files by name, ``sentence_cap`` the first sentences of each file;
    ``glob`` picks the files of a directory tree.

    Files are scanned by line, each exactly once. Inside an input split the lines are
    numbered by a count of sentence starts that runs along with the scan, so no text moves.
    A first pass counts the starts of each split, which shift the numbers of the next.
    """
    paths, name_filter = _files(spark, path, file_cap, glob)
    # Whether a line is blank shows in its first bytes, unless it begins with a blank.
    begin = F.substring("value", 1, 1)
    mark = F.when(begin > " ", begin).otherwise(F.col("value"))
    lines = numbered_lines(scan(spark, paths, glob=name_filter).withColumn("mark", mark), _text_or_blank, every=False)
    tokens = lines.where((F.trim("value") != "") & ~F.startswith("value", F.lit("#")))
    if sentence_cap is not None:
        tokens = tokens.where(F.col("sent_id") <= sentence_cap)
    # Split once, in a projection of its own.
    tokens = tokens.select("file", "sent_id", F.explode(F.array(F.split("value", "\t"))).alias("fields"))
    tokens = tokens.select("file", "sent_id", *[
        F.get("fields", F.lit(COLUMNS.index(name))).alias(name) for name in TOKEN_FIELDS])
    return _tokens(tokens, "file", "sent_id").select(TOKEN_COLUMNS)


def _text_or_blank(lines: pa.Array) -> np.ndarray:
    """1 for a line with text, -1 for a blank one."""
    size = pc.binary_length(pc.ascii_trim_whitespace(lines))
    return np.where(size.to_numpy(zero_copy_only=False) > 0, 1, -1)


def _files(spark: SparkSession, path, file_cap: int | None, glob: str) -> tuple[list[str], str | None]:
    """Paths to read, and the name filter when they are directory trees."""
    if not isinstance(path, str):
        return sorted(path)[:file_cap], None
    if file_cap is not None:
        return first_paths(spark, path, glob, file_cap), None
    # A name filter would hide a single file of another name.
    single = path.endswith((".conllu", ".conllu.gz", ".txt", ".txt.gz"))
    return [path], None if single else glob


def read_conllu_tokens(spark: SparkSession, path: str | Sequence[str],
                       file_cap: int | None = None, glob: str = GLOB,
                       with_file: bool = False) -> DataFrame:
    """Tokens without sentence numbers, for counting.

    One line-by-line pass that reads just the needed fields; either line end is fine.
    The file of each token costs time on every row, so it is there on request only.
    """
    paths, name_filter = _files(spark, path, file_cap, glob)
    reader = (spark.read.schema(", ".join(f"{name} string" for name in COLUMNS))
              .option("recursiveFileLookup", True).option("sep", "\t").option("quote", "")
              .option("comment", "#"))
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    rows = reader.csv(paths)
    if not with_file:
        return _tokens(rows)
    file = F.col("_metadata.file_path").alias("file")
    return _tokens(rows.select(file, *TOKEN_FIELDS), "file")
