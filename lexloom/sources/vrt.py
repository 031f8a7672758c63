"""VRT scan: tokens between ``<sentence>`` and ``</sentence>`` lines."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexloom.functions.feats import equals_for_underscores
from lexloom.operators.lookup import lookup_join, numbered_lines
from lexloom.sources.text import TOKEN_COLUMNS, scan
from lexloom.storage import keep

GLOB = "*.vrt{,.gz}"

# Columns of a file that does not name its attributes.
UNNAMED = {"form": 0, "token_id": 1, "lemma": 2, "upos": 4, "feats": 5}

# VRT attribute holding each token column.
ATTRIBUTES = {"token_id": "ref", "form": "word", "lemma": "lemma", "upos": "pos", "feats": "msd"}


HEADER = re.compile(r"positional-attributes.*?:\s+(.*)/")


def _places(names: str) -> str:
    """Where a header's attributes put each token column, counted from 0; nothing where it lacks one."""
    listed = names.split()
    return ",".join(str(listed.index(a)) if a in listed else "" for a in ATTRIBUTES.values())


def _header(lines: pa.Array) -> pa.Array:
    """The places of the token columns from header comments, null for other lines."""
    comments = pc.and_(pc.starts_with(lines, "<!--"), pc.match_substring(lines, "positional-attributes"))
    out = [None] * len(lines)
    for i in np.flatnonzero(comments.to_numpy(zero_copy_only=False)).tolist():
        found = HEADER.search(lines[i].as_py())
        out[i] = found and _places(found[1])
    return pa.array(out, pa.string())


def _marks(lines: pa.Array) -> np.ndarray:
    """1 where a sentence opens, -1 where it closes."""
    opens = pc.starts_with(lines, "<sentence").to_numpy(zero_copy_only=False)
    closes = pc.starts_with(lines, "</sentence").to_numpy(zero_copy_only=False)
    return opens.astype(np.int8) - closes.astype(np.int8)


def _lines(spark: SparkSession, path: str | Sequence[str], glob: str) -> DataFrame:
    is_tree = isinstance(path, str) and not path.endswith((".vrt", ".vrt.gz"))
    lines = scan(spark, path, glob=glob if is_tree else None)
    ended = F.endswith("value", F.lit("\r"))
    return lines.withColumn("value", F.when(ended, F.regexp_replace("value", "\r$", "")).otherwise(F.col("value")))


def _listed(places: Column) -> Column:
    """The places as numbers, null for what a file lacks."""
    return F.transform(F.split(places, ","), lambda p: F.when(p != "", p.cast("int")))


def _fields(lines: DataFrame, attributes: Sequence[str] | None) -> DataFrame:
    """Token columns of the lines; ``header`` lists their places in the file, if it names them."""
    rows = lines.where((F.trim("value") != "") & ~F.startswith("value", F.lit("<")))
    keys = [name for name in ("file", "sent_id") if name in rows.columns]
    places = F.col("header") if attributes is None else _listed(F.lit(_places(" ".join(attributes))))
    rows = rows.select(*keys, F.explode(F.array(F.struct(
        places.alias("places"), F.split("value", "\t").alias("fields")))).alias("line"))
    places, fields = F.col("line.places"), F.col("line.fields")

    def column(place: int, name: str):
        named = F.get(fields, F.get(places, F.lit(place)))
        if name == "feats":
            named = equals_for_underscores(named)
        return F.when(places.isNull(), F.get(fields, F.lit(UNNAMED[name]))).otherwise(named).alias(name)

    return rows.select(*keys, *[column(i, name) for i, name in enumerate(ATTRIBUTES)])


def read_vrt(spark: SparkSession, path: str | Sequence[str],
             attributes: Sequence[str] | None = None, glob: str = GLOB) -> DataFrame:
    """Tokens with the number of their sentence in the file.

    The attribute order is the one given, else the one in the file's
    ``positional-attributes`` header, else a fixed one. Feature strings of named
    attributes are rewritten to ``K=V`` form. The corpus is read twice: once for sentence
    counts and headers, once for the tokens.
    """
    # Sentence tags show in the first letters.
    lines = _lines(spark, path, glob).withColumn("mark", F.substring("value", 1, len("</sentence")))
    lines = numbered_lines(lines, _marks, every=True, header=_header, read_header=_listed)
    return _fields(lines.where("inside"), attributes).select(TOKEN_COLUMNS)


def read_vrt_tokens(spark: SparkSession, path: str | Sequence[str],
                    attributes: Sequence[str] | None = None, glob: str = GLOB) -> DataFrame:
    """Tokens without sentence numbers, for counting: one pass, and one for headers.

    Token lines count wherever they stand.
    """
    lines = _lines(spark, path, glob)
    if attributes is not None:
        return _fields(lines.drop("file", "block"), attributes)
    names = F.split(F.trim(F.regexp_extract("value", HEADER.pattern, 1)), r"\s+")
    places = F.array_join(F.array(*[F.coalesce(F.nullif(F.array_position(names, a) - 1, F.lit(-1)).cast("string"), F.lit(""))
                                    for a in ATTRIBUTES.values()]), ",")
    headers = (lines.where(F.startswith("value", F.lit("<!--")) & F.contains("value", F.lit("positional-attributes")))
               .groupBy("file").agg(F.min_by(_listed(places), "block").alias("header")))
    return _fields(lookup_join(lines, keep(headers, "headers"), ["file"]), None).drop("file")
