"""Letter-group frequencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lexloom.functions.grams import bigrams, final_trigram, has_trigrams, initial_trigram
from lexloom.operators.lookup import lookup_join
from lexloom.storage import keep


def _gram_sums(rows: DataFrame, gram: Column) -> DataFrame:
    return (rows.select(gram.alias("gram"), "frequency")
            .groupBy("gram").agg(F.sum("frequency").alias("frequency")))


def initial_gram_freqs(forms: DataFrame) -> DataFrame:
    """Frequency of the first three letters, over forms of four letters or more."""
    return _gram_sums(forms.where(has_trigrams(F.col("form"))), initial_trigram(F.col("form")))


def final_gram_freqs(forms: DataFrame) -> DataFrame:
    """Frequency of the last three letters, over forms of four letters or more."""
    return _gram_sums(forms.where(has_trigrams(F.col("form"))), final_trigram(F.col("form")))


def bigram_freqs(forms: DataFrame, distinct: bool = False) -> DataFrame:
    """Frequency of letter pairs; with ``distinct`` a pair counts once per word."""
    pairs = bigrams(F.col("form"))
    return _gram_sums(forms, F.explode(F.array_distinct(pairs) if distinct else pairs))


def bigram_means(forms: DataFrame, freqs: DataFrame, distinct: bool = False) -> DataFrame:
    """Per form the mean frequency of its letter pairs, rounded down."""
    pairs = bigrams(F.col("form"))
    rows = forms.select("form", F.explode(F.array_distinct(pairs) if distinct else pairs).alias("gram"))
    # A form's pairs sit side by side, so the map-side sum leaves about a row per form.
    return (lookup_join(rows, keep(freqs, "bigrams"), ["gram"])
            .groupBy("form")
            .agg(F.sum(F.coalesce("frequency", F.lit(0))).alias("total"), F.count("*").alias("pairs"))
            .select("form", F.floor(F.col("total") / F.col("pairs")).alias("frequency")))


def nonword_bigrams(words: DataFrame, freqs: DataFrame, denominator: str = "length") -> DataFrame:
    """Mean letter-pair frequency of listed nonwords, unseen pairs counting zero.

    ``words`` holds ``item`` and ``position``. The sum is divided by the word's
    ``length`` or, as for lexicon words, by its number of ``pairs``.
    """
    if denominator not in ("length", "pairs"):
        raise ValueError(f"divide by length or pairs, not by '{denominator}'")
    items = words.groupBy("item").agg(F.max("position").alias("order"))
    rows = items.select("item", "order", F.explode_outer(bigrams(F.col("item"))).alias("gram"))
    sums = (lookup_join(rows, keep(freqs, "bigrams"), ["gram"])
            .groupBy("item", "order")
            .agg(F.sum(F.coalesce("frequency", F.lit(0))).alias("total"),
                 F.count("gram").alias("pairs")))
    size = F.length("item") if denominator == "length" else F.greatest("pairs", F.lit(1))
    return sums.select("order", F.col("item").alias("form"),
                       F.floor(F.col("total") / size).alias("bigramfreq"))


def gram_test(kind: str, gram: str) -> Column:
    """Whether a form has a gram of the given kind: initial, final or bigram."""
    form = F.col("form")
    if kind == "initial":
        return has_trigrams(form) & (initial_trigram(form) == gram)
    if kind == "final":
        return has_trigrams(form) & (final_trigram(form) == gram)
    if kind == "bigram":
        return F.contains(form, F.lit(gram))
    raise ValueError(f"grams are initial, final or bigram, not '{kind}'")


def gram_contributions(forms: DataFrame, grams: Sequence[str], kind: str = "bigram") -> DataFrame:
    """A column per gram with what each form adds to it, zero if nothing.

    Each column is an expression on the form, so no row moves.
    """
    return forms.select("form", *[
        F.when(gram_test(kind, gram), F.col("frequency")).otherwise(F.lit(0)).alias(gram)
        for gram in grams])


def gram_contribution_rows(forms: DataFrame, kind: str = "bigram") -> DataFrame:
    """The same in long form for all grams: (form, gram, frequency), zeros left out."""
    form = F.col("form")
    if kind == "bigram":
        return forms.select("form", F.explode(F.array_distinct(bigrams(form))).alias("gram"), "frequency")
    gram = {"initial": initial_trigram, "final": final_trigram}[kind]
    return forms.where(has_trigrams(form)).select("form", gram(form).alias("gram"), "frequency")
