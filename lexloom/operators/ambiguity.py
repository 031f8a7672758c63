"""Form and lemma aggregates and the ambiguity measures built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexloom.functions.words import compound_parts, without_separator

# Fixed value: above this share a form counts as belonging to one lemma.
CLEAR_SHARE = 0.99


def form_lemma_counts(words: DataFrame) -> DataFrame:
    """Frequency by lemma, form and word class (auxiliaries with verbs)."""
    return (words.groupBy("lemma", "form", F.col("posx").alias("pos"))
            .agg(F.sum("frequency").alias("frequency")))


def form_totals(counts: DataFrame) -> DataFrame:
    """Per form its frequency and the number of (lemma, pos) readings."""
    return counts.groupBy("form").agg(F.sum("frequency").alias("frequency"),
                                      F.count("*").alias("numforms"))


def lemmaforms(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Each (lemma, form, pos) with the form's total and its share of it.

    The total comes by a join, which adaptive execution can split for a form with
    very many readings, where a window would hold the form in one task.
    """
    sums = totals.select("form", F.col("frequency").alias("formsum"))
    return counts.join(sums, "form").select(
        "lemma", "form", "pos", "frequency", "formsum",
        (F.col("frequency") / F.col("formsum")).alias("formpct"))


def lemmas(shares: DataFrame) -> DataFrame:
    """Per (lemma, pos) its frequency, length, compound parts and ambiguity.

    Ambiguity is the part of the frequency in forms that are not clearly this
    lemma's. A form with a single reading has share 1, so the share alone decides.
    """
    freq = F.col("lemmafreq")
    clear = F.when(F.col("formpct") > CLEAR_SHARE, F.col("frequency"))
    return (
        shares.groupBy("lemma", "pos")
        .agg(F.sum("frequency").alias("lemmafreq"), F.sum(clear).alias("clear"))
        .select("lemma", without_separator(F.col("lemma")).alias("lemmac"), "pos", "lemmafreq",
                F.length(without_separator(F.col("lemma"))).alias("lemmalen"),
                compound_parts(F.col("lemma")).alias("comparts"),
                F.coalesce((freq - F.col("clear")) / freq, F.lit(1.0)).alias("amblemma"))
    )


def form_ambiguity(words: DataFrame, shares: DataFrame) -> DataFrame:
    """Word rows with ``ambform``, the share of the form's other readings."""
    readings = shares.select("lemma", "form", F.col("pos").alias("posx"),
                             (F.lit(1) - F.col("formpct")).alias("ambform"))
    return words.join(readings, ["lemma", "form", "posx"])
