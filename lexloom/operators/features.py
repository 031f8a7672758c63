"""Feature tables of a lexicon."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from lexloom.functions.feats import EMPTY, feature_columns
from lexloom.operators.lookup import lookup_join, number_sorted
from lexloom.storage import keep


def feature_table(words: DataFrame, features: dict[str, str]) -> DataFrame:
    """One row per distinct (feats, pos) with a column for each core feature."""
    return (words.select("feats", "pos").distinct()
            .select("feats", "pos", *feature_columns(F.col("feats"), features)))


def numbered_features(words: DataFrame, features: dict[str, str]) -> DataFrame:
    """The feature table with ``featid``, numbered by (feats, pos)."""
    pairs = number_sorted(words.select("feats", "pos").distinct(), ["feats", "pos"], "featid")
    return pairs.select("featid", "feats", "pos", *feature_columns(F.col("feats"), features))


def extend_features(known: DataFrame, words: DataFrame, features: dict[str, str]) -> DataFrame:
    """The feature table ``known`` with rows for the (feats, pos) of ``words`` it lacks.

    Ids are never changed or used again: new pairs are numbered, in order, above the highest id.
    Pass stored tables; ``known`` is not sorted or numbered again.
    """
    unseen = words.select("feats", "pos").distinct().join(
        known.select("feats", "pos"), ["feats", "pos"], "left_anti")
    highest = known.agg(F.max("featid")).first()[0] or 0
    fresh = number_sorted(unseen, ["feats", "pos"], "featid").select(
        (F.col("featid") + F.lit(highest)).alias("featid"), "feats", "pos",
        *feature_columns(F.col("feats"), features))
    return known.select(fresh.columns).unionByName(fresh)


def with_feature_ids(words: DataFrame, numbered: DataFrame) -> DataFrame:
    """Word rows with the id of their (feats, pos)."""
    ids = keep(numbered.select("feats", "pos", "featid"), "featids")
    return lookup_join(words, ids, ["feats", "pos"], "inner")


def feature_values(numbered: DataFrame,
                   columns: Iterable[str] = ("derivation", "clitic", "nouncase")) -> DataFrame:
    """Multi-valued features, one row per value; features the language lacks are skipped."""
    present = [c for c in columns if c in numbered.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in present])
    if not present:
        pairs = pairs.cast("array<struct<feature:string,value:string>>")
    return (numbered.select("featid", F.inline(pairs))
            .where(F.col("value") != EMPTY)
            .select("featid", "feature", F.explode(F.split("value", ",")).alias("value")))
