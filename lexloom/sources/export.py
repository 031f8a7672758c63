"""Text exports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexloom.operators.words import word_stats
from lexloom.sources.store import EXPORTED, Lexicon


def write_text(df: DataFrame, path: str, tsv: bool = False) -> None:
    """Write a table or query result as CSV or TSV with a header; quotes are doubled."""
    (df.write.mode("overwrite").option("header", True).option("sep", "\t" if tsv else ",")
     .option("escape", '"').csv(path))


def read_text(spark: SparkSession, path: str, schema, tsv: bool = False) -> DataFrame:
    """Read such an export back."""
    return (spark.read.schema(schema).option("header", True).option("sep", "\t" if tsv else ",")
            .option("escape", '"').csv(path))


def export_tables(lexicon: Lexicon, folder: str, tsv: bool = False,
                  names: Iterable[str] = EXPORTED) -> list[str]:
    """Every table as a text dataset of its own; returns the folders."""
    paths = []
    for name in names:
        paths.append(f"{folder}/{name}")
        write_text(lexicon[name], paths[-1], tsv)
    return paths


def _thousandths(value: Column) -> Column:
    return F.round(value * 1000) / 1000


def _per_million(value: Column, total: int) -> Column:
    return F.round(value * F.lit(1e9) / F.lit(total)) / 1000


def combined_rows(lexicon: Lexicon, min_frequency: int | None = None,
                  limit: int | None = None) -> DataFrame:
    """The lexicon as one table, as a search would show it, most frequent rows first.

    Only rows above ``min_frequency``; frequencies per million and ambiguities have
    three decimals. Twins of one verb reading are one row.
    """
    col = F.col
    rows = lexicon["wide"].where("primary")
    if min_frequency is not None:
        rows = rows.where(col("frequencyx") > min_frequency)
    names = {"nouncase": "case", "nnumber": "number"}
    out = rows.select(
        "lemma", "lemmafreq",
        _per_million(col("lemmafreq"), lexicon.totals["lemmafreq"]).alias("rellemmafreq"),
        "lemmalen", _thousandths(col("amblemma")).alias("amblemma"),
        "form", col("posx").alias("pos"), "len", "hood",
        _thousandths(col("ambform")).alias("ambform"),
        col("frequencyx").alias("frequency"),
        _per_million(col("frequencyx"), lexicon.totals["frequency"]).alias("relfrequency"),
        "feats", *[col(c).alias(names.get(c, c)) for c in lexicon.features.values()],
        "initgramfreq", "fingramfreq", "bigramfreq",
    ).orderBy(col("frequency").desc(), "lemma", "form", "pos", "feats")
    return out if limit is None else out.limit(limit)


def export_combined(lexicon: Lexicon, path: str, tsv: bool = False,
                    min_frequency: int | None = None, limit: int | None = None) -> None:
    write_text(combined_rows(lexicon, min_frequency, limit), path, tsv)


def export_release(lexicon: Lexicon, folder: str, source: str, tsv: bool = False) -> None:
    """All tables, the combined table and the statistics in one folder."""
    export_tables(lexicon, f"{folder}/tables", tsv)
    export_combined(lexicon, f"{folder}/tables/combined", tsv)
    stats = word_stats(lexicon["lexicon"]).select(
        F.lit(source).alias("source"),
        *[F.lit(value).alias(key) for key, value in sorted(lexicon.metadata.items())],
        "rows", "frequency")
    stats.write.mode("overwrite").json(f"{folder}/statistics")


def write_rejects(rejects: DataFrame, path: str) -> None:
    """Rejected tokens as TSV lines without a header."""
    rejects.write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema("file string, sent_id long, form string, lemma string")
            .option("sep", "\t").option("quote", "").csv(path))
