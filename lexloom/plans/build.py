"""From counted words to a stored, searchable lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexloom.functions.grams import final_trigram, has_trigrams, initial_trigram
from lexloom.languages import features_for, metadata_for
from lexloom.operators.ambiguity import form_lemma_counts, form_totals, lemmaforms, lemmas
from lexloom.operators.features import extend_features, feature_values, numbered_features
from lexloom.operators.grams import (bigram_freqs, bigram_means, final_gram_freqs,
                                     initial_gram_freqs)
from lexloom.operators.lookup import lookup_join
from lexloom.operators.neighbours import (AUTO_FREQUENCY, MIN_FREQUENCY, flag_accepted,
                                          hamming_hood)
from lexloom.operators.words import BASE_COLUMNS, count_words
from lexloom.sources.store import Lexicon, begin, complete
from lexloom.storage import keep, kept_outside

# Stored lexicon columns beside the base ones.
DERIVED_COLUMNS = ["hood", "ambform"]
# Columns of the search table beside base and feature ones.
WIDE_COLUMNS = [*DERIVED_COLUMNS, "lemmac", "lemmafreq", "lemmalen", "comparts", "amblemma",
                "bigramfreq", "initgramfreq", "fingramfreq"]


def build_from_tokens(tokens: DataFrame, path: str, langcode: str = "fi",
                      origcase: bool = False, **options) -> Lexicon:
    """Count a token stream and store its lexicon."""
    words = count_words(tokens, features_for(langcode), origcase)
    return build_lexicon(words, path, langcode, **options)


def build_lexicon(words: DataFrame, path: str, langcode: str = "fi",
                  accepted_forms: DataFrame | None = None,
                  auto: int = AUTO_FREQUENCY, minimum: int = MIN_FREQUENCY,
                  transpositions: bool = False, known_features: DataFrame | None = None) -> Lexicon:
    """Store word rows with every derived table.

    Each step writes a table the next ones read, so nothing is computed twice and
    no step depends on memory held by an executor. A mark is set last, without which
    a lexicon cannot be opened. With ``known_features``, the ``features`` table of an
    earlier lexicon, ids in it stay as they are.
    """
    spark = words.sparkSession
    features = features_for(langcode)

    def store(df: DataFrame, name: str) -> DataFrame:
        return keep(df, path=f"{path}/{name}")

    if not kept_outside(words, BASE_COLUMNS, path):
        words = keep(words.select(BASE_COLUMNS), "words")
    if known_features is not None:
        known_features = keep(known_features, "known")  # it may lie in the folder written to
    begin(spark, path)
    counts = keep(form_lemma_counts(words), "counts")
    totals = keep(form_totals(counts), "forms")

    init = store(initial_gram_freqs(totals), "init_grams")
    fin = store(final_gram_freqs(totals), "fin_grams")
    pairs = store(bigram_freqs(totals), "bigrams")
    means = store(bigram_means(totals, pairs), "word_bigrams")

    # Kept: several key tables start from it, and accepted forms may be a whole query.
    flagged = keep(flag_accepted(totals, accepted_forms, auto, minimum), "flagged")
    hood = hamming_hood(flagged, transpositions)
    forms = store(totals.join(hood, "form"), "forms")
    shares = store(lemmaforms(counts, totals), "lemmaforms")
    lemma_rows = store(lemmas(shares), "lemmas")

    numbered = store(numbered_features(words, features) if known_features is None
                     else extend_features(known_features, words, features), "features")
    store(feature_values(numbered), "feature_values")

    # Frequent words first in each file: the usual frequency filters read the first pages only. The rows stay
    # where their last join put them; to range them over all files would move them once more.
    order = [F.col("frequencyx").desc(), F.col("form")]
    rows = wide_rows(words, forms, shares, lemma_rows, init, fin, means)
    rows = lookup_join(rows, numbered.drop("featid"), ["feats", "pos"], "inner")
    rows = rows.select(*BASE_COLUMNS, *WIDE_COLUMNS, *features.values())
    wide = store(rows.sortWithinPartitions(*order), "wide")
    store(wide.select(*BASE_COLUMNS, *DERIVED_COLUMNS), "lexicon")
    store(corpus_totals(words, lemma_rows, init, fin, pairs), "totals")
    store(metadata_table(spark, langcode), "metadata")
    complete(spark, path)
    return Lexicon.load(spark, path)


def wide_rows(words: DataFrame, forms: DataFrame, shares: DataFrame, lemma_rows: DataFrame,
              init: DataFrame, fin: DataFrame, means: DataFrame) -> DataFrame:
    """Word rows with everything but the feature columns a search can ask for.

    Form properties meet on the form, are carried to the readings of each form, then
    to the word rows: only the last join moves the word rows themselves.
    """
    form = F.col("form")
    grams_apply = has_trigrams(form)

    def edge(rows: DataFrame, grams: DataFrame, gram, name: str) -> DataFrame:
        table = grams.select("gram", F.col("frequency").alias(name))
        joined = lookup_join(rows.withColumn("gram", F.when(grams_apply, gram)), table, ["gram"])
        return joined.withColumn(name, F.coalesce(name, F.lit(0))).drop("gram")

    per_form = forms.select("form", "hood").join(
        means.select("form", F.col("frequency").alias("bigramfreq")), "form", "left")
    per_form = edge(per_form, init, initial_trigram(form), "initgramfreq")
    per_form = edge(per_form, fin, final_trigram(form), "fingramfreq")

    readings = (
        shares.select("lemma", "form", F.col("pos").alias("posx"),
                      (F.lit(1) - F.col("formpct")).alias("ambform"))
        .join(per_form, "form")
        .join(lemma_rows.withColumnRenamed("pos", "posx"), ["lemma", "posx"])
    )
    return (
        words.join(readings, ["lemma", "form", "posx"])
        .select(*BASE_COLUMNS, *WIDE_COLUMNS)
    )


def corpus_totals(words: DataFrame, lemma_rows: DataFrame, init: DataFrame, fin: DataFrame,
                  pairs: DataFrame) -> DataFrame:
    """(name, total): the sums that relative frequencies are taken of."""
    parts = [("frequency", words, "frequency"), ("lemmafreq", lemma_rows, "lemmafreq"),
             ("initgramfreq", init, "frequency"), ("fingramfreq", fin, "frequency"),
             ("bigramfreq", pairs, "frequency")]
    rows = [df.agg(F.coalesce(F.sum(column), F.lit(0)).alias("total"))
            .select(F.lit(name).alias("name"), "total") for name, df, column in parts]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def metadata_table(spark: SparkSession, langcode: str) -> DataFrame:
    """(key, value) rows of a lexicon's metadata."""
    pairs = [F.struct(F.lit(key).alias("key"), F.lit(value).alias("value"))
             for key, value in metadata_for(langcode).items()]
    return spark.range(1).select(F.inline(F.array(*pairs)))
