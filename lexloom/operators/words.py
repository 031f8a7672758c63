"""Tokens to word rows: the lexicon without its derived columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from lexloom.functions.feats import core_feats
from lexloom.functions.words import posx, valid_word

WORD_KEY = ["lemma", "form", "pos", "feats"]
BASE_COLUMNS = ["lemma", "form", "pos", "posx", "feats", "len",
                "frequency", "frequencyx", "primary"]


def _accepted() -> Column:
    """Form and lemma are both valid words in lower case."""
    return valid_word(F.lower("form")) & valid_word(F.lower("lemma"))


def accepted_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens that count."""
    return tokens.where(_accepted())


def rejected_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens left out though form and lemma are longer than one character."""
    return (tokens.where(~_accepted() & (F.length("form") > 1) & (F.length("lemma") > 1))
            .select("file", "sent_id", "form", "lemma"))


def count_words(tokens: DataFrame, core_names: Iterable[str], origcase: bool = False) -> DataFrame:
    """Word rows with their frequency in a corpus.

    Identical tokens are counted first, with a cheap length test only. The validity
    patterns, case folding and feature selection then run once per distinct token
    instead of once per token, and the second count moves far fewer rows.
    """
    distinct = (
        tokens.where((F.length("form") > 1) & (F.length("lemma") > 1) & (F.length("upos") > 0))
        .groupBy("form", "lemma", "upos", "feats").agg(F.count("*").alias("frequency"))
    )
    fold = (lambda name: F.col(name)) if origcase else F.lower
    # Tied to the count, the test stays above the grouping; alone, the optimizer would
    # move it below and run it for every token again.
    counted = distinct.where(F.when(F.col("frequency") > 0, _accepted()).otherwise(False))
    rows = counted.select(
        fold("lemma").alias("lemma"), fold("form").alias("form"), F.col("upos").alias("pos"),
        core_feats(F.col("feats"), core_names).alias("feats"), "frequency")
    return sum_words(rows)


def sum_words(rows: DataFrame) -> DataFrame:
    """Sum word rows of equal key and add the combined verb/auxiliary frequency.

    A verb and its auxiliary twin meet in one group, so ``frequencyx`` needs no
    second shuffle. ``primary`` marks one row of each such pair, which makes leaving
    out twins a filter later.
    """
    auxiliary = F.col("pos") == "AUX"
    grouped = (
        rows.withColumn("posx", posx(F.col("pos")))
        .groupBy("lemma", "form", "posx", "feats")
        .agg(F.sum(F.when(~auxiliary, F.col("frequency"))).alias("main"),
             F.sum(F.when(auxiliary, F.col("frequency"))).alias("aux"))
    )
    variants = F.array_compact(F.array(
        F.when(F.col("main").isNotNull(), F.struct(
            F.col("posx").alias("pos"), F.col("main").alias("frequency"),
            F.lit(True).alias("primary"))),
        F.when(F.col("aux").isNotNull(), F.struct(
            F.lit("AUX").alias("pos"), F.col("aux").alias("frequency"),
            F.col("main").isNull().alias("primary"))),
    ))
    both = F.coalesce("main", F.lit(0)) + F.coalesce("aux", F.lit(0))
    return (
        grouped.select("lemma", "form", "posx", "feats", both.alias("frequencyx"), F.inline(variants))
        .withColumn("len", F.length("form"))
        .select(BASE_COLUMNS)
    )


def merge_words(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Several lexicons as one: frequencies of equal rows are summed."""
    columns = [*WORD_KEY, "frequency"]
    rows = first.select(columns)
    for other in others:
        rows = rows.unionByName(other.select(columns))
    return sum_words(rows)


def dropped(min_frequency: int | None = None, drop_pos: Iterable[str] = (),
            max_length: int | None = None) -> Column:
    """Whether pruning drops a word row: it is too rare or too long, or of an unwanted class."""
    drop_pos = list(drop_pos)
    if min_frequency is None and not drop_pos and max_length is None:
        raise ValueError("no pruning criteria given")
    hit = F.lit(False)
    if min_frequency is not None:
        hit = hit | (F.col("frequency") < min_frequency)
    if drop_pos:
        hit = hit | F.col("pos").isin(drop_pos)
    if max_length is not None:
        hit = hit | (F.length("form") > max_length)
    return hit


def prune_words(words: DataFrame, min_frequency: int | None = None,
                drop_pos: Iterable[str] = (), max_length: int | None = None) -> DataFrame:
    """Drop rare rows, word classes or long forms, and recompute the base columns."""
    return sum_words(words.where(~dropped(min_frequency, drop_pos, max_length)))


def prune_report(words: DataFrame, min_frequency: int | None = None,
                 drop_pos: Iterable[str] = (), max_length: int | None = None) -> DataFrame:
    """Per criterion: rows in total, rows it would delete, rows it would leave."""
    drop_pos = list(drop_pos)
    criteria = []
    if drop_pos:
        criteria.append(("pos", F.col("pos").isin(drop_pos)))
    if min_frequency is not None:
        criteria.append(("frequency", F.col("frequency") < min_frequency))
    if max_length is not None:
        criteria.append(("length", F.length("form") > max_length))
    if not criteria:
        raise ValueError("no pruning criteria given")
    counted = words.agg(F.count("*").alias("total"),
                        *[F.count_if(hit).alias(name) for name, hit in criteria])
    lines = F.array(*[
        F.struct(F.lit(name).alias("criterion"), F.col("total"), F.col(name).alias("deleted"),
                 (F.col("total") - F.col(name)).alias("remaining"))
        for name, _ in criteria])
    return counted.select(F.inline(lines))


def word_stats(words: DataFrame) -> DataFrame:
    """Row count and cumulative frequency."""
    return words.agg(F.count("*").alias("rows"), F.sum("frequency").alias("frequency"))
