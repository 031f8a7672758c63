"""Orthographic neighbours.

All joins here meet on keys made from words. A wildcard pattern is shared by at most
one form per character of the word alphabet, and a deletion or swap key names a single
form, so no key group can grow with the corpus.

Forms under ``LONG_WORD`` letters meet on the changed words themselves and their counts add up
numbers per key, so no pairs are built. A longer form makes its keys as hashes from
prefix sums, in linear time, and carries a digest instead of its letters; pairs that
meet are compared letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexloom.functions import letterhash
from lexloom.functions.grams import LONG_WORD, deletions, swaps, wildcard_patterns
from lexloom.operators.lookup import fits_broadcast
from lexloom.storage import keep

# Frequency from which a form is always, and from which it may be, a neighbour.
AUTO_FREQUENCY = 10000
MIN_FREQUENCY = 100


def flag_accepted(forms: DataFrame, accepted_forms: DataFrame | None = None,
                  auto: int = AUTO_FREQUENCY, minimum: int = MIN_FREQUENCY) -> DataFrame:
    """(form, frequency, accepted): whether a form counts as somebody's neighbour.

    Frequent forms are accepted, rare ones are not; in between, a form must be in
    ``accepted_forms`` (column ``form``), for example a morphologically checked list.
    """
    frequency = F.col("frequency")
    rows = forms.select("form", "frequency")
    if accepted_forms is None:
        return rows.withColumn("accepted", frequency >= auto)
    known = accepted_forms.select("form").distinct().withColumn("known", F.lit(True))
    return rows.join(known, "form", "left").select(
        "form", "frequency",
        ((frequency >= auto)
         | ((frequency >= minimum) & F.coalesce("known", F.lit(False)))).alias("accepted"))


def _meet(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Inner join on a bounded key: broadcast a counted small table, shuffle a large one."""
    if fits_broadcast(table):
        table = F.broadcast(table)
    return rows.join(table, on)


class _Lengths:
    """How many forms, and accepted forms, have each length.

    A form makes keys only if some form of the fitting length can answer them. So a junk token
    of a million letters, which has no accepted form near its length, makes none.
    """

    def __init__(self, flagged: DataFrame):
        self.counts = keep(flagged.groupBy(F.length("form").alias("size")).agg(
            F.count("*").alias("_forms"), F.count_if("accepted").alias("_accepted")), "lengths")

    def having(self, rows: DataFrame, shift: int, enough: Column) -> DataFrame:
        """Rows for which ``enough`` holds of the lengths ``shift`` letters above theirs."""
        table = self.counts.select((F.col("size") - shift).alias("_size"), "_forms", "_accepted")
        met = _meet(rows.withColumn("_size", F.length("form")), table, "_size")
        return met.where(enough).select(rows.columns)

    def with_accepted(self, rows: DataFrame, shift: int) -> DataFrame:
        """Rows (``form, accepted``) with an accepted other form of the fitting length."""
        own = F.col("accepted").cast("int") if shift == 0 else F.lit(0)
        return self.having(rows, shift, F.col("_accepted") - own > 0)

    def asked(self, rows: DataFrame, shift: int) -> DataFrame:
        """Rows that a form of the fitting length may ask for, itself not counted."""
        return self.having(rows, shift, F.col("_forms") > (1 if shift == 0 else 0))


    def longest(self) -> int:
        """Letters of the longest form."""
        return self.counts.agg(F.max("size")).first()[0] or 0


def _short(rows: DataFrame) -> DataFrame:
    return rows.where(F.length("form") < LONG_WORD)


def _substitution_counts(flagged: DataFrame, lengths: _Lengths) -> DataFrame:
    """(form, n) rows that add up to the accepted forms one substitution away."""
    pattern = F.explode(wildcard_patterns(F.col("form"))).alias("pattern")
    accepted = lengths.asked(_short(flagged.where("accepted")), 0)
    held = keep(accepted.select(pattern).groupBy("pattern").agg(F.count("*").alias("n")), "patterns")
    asking = lengths.with_accepted(_short(flagged), 0)
    found = _meet(asking.select("form", pattern), held, "pattern").select("form", "n")
    # An accepted form meets itself once per letter; take that off again.
    own = asking.where("accepted").select("form", (-F.length("form")).cast("long").alias("n"))
    none = flagged.select("form", F.lit(0).cast("long").alias("n"))
    return found.unionByName(own).unionByName(none)


def _keyed_counts(rows: DataFrame, key: Column, table: DataFrame) -> DataFrame:
    """(form, n) rows: one for each key of a form that is itself an accepted form."""
    keys = rows.select("form", F.explode(key).alias("key"))
    targets = keep(table.select(F.col("form").alias("key")), "targets")
    return _meet(keys, targets, "key").select("form", F.lit(1).cast("long").alias("n"))


def _insertion_counts(flagged: DataFrame, lengths: _Lengths) -> DataFrame:
    """(form, n) rows: one for each accepted form that is this form plus a letter."""
    longer = lengths.asked(_short(flagged.where("accepted")), -1).select(
        F.explode(deletions(F.col("form"))).alias("key"))
    sums = keep(longer.groupBy("key").agg(F.count("*").alias("n")), "insertions")
    keyed = lengths.with_accepted(_short(flagged), 1).select("form", F.col("form").alias("key"))
    return _meet(keyed, sums, "key").select("form", "n")


# Key rows handed on at a time.
_KEYS_AT_ONCE = 1 << 16


def _hash_keys(rows: DataFrame, keys_of, shift: int = 0) -> DataFrame:
    """(id, size, place, key) of forms; ``size`` is the length of what remains. Letters stay behind."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for form, ident in zip(batch.column(0), batch.column(1)):
                codes = letterhash.letters(form.as_py())
                places, keys = keys_of(codes)
                for at in range(0, len(keys), _KEYS_AT_ONCE):
                    part = keys[at:at + _KEYS_AT_ONCE]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ident.as_py()] * len(part), pa.binary()),
                         pa.array(np.full(len(part), len(codes) - shift, np.int32)),
                         pa.array(places[at:at + _KEYS_AT_ONCE].astype(np.int32)), pa.array(part)],
                        names=["id", "size", "place", "key"])

    return rows.select("form", F.unhex(F.sha2("form", 256)).alias("id")).mapInArrow(
        run, "id binary, size int, place int, key long")


def _whole_keys(rows: DataFrame) -> DataFrame:
    return _hash_keys(rows, lambda codes: (np.zeros(1, np.int64), letterhash.whole_key(codes)))


def _long_pairs(flagged: DataFrame, lengths: _Lengths, other_length: bool,
                transpositions: bool) -> DataFrame:
    """(form, neighbour, frequency) where the longer of the two has ``LONG_WORD`` letters or more.

    Key rows are a few bytes each, so a form of n letters costs in proportion to n. Only pairs
    that meet on a key bring their letters together, and those are compared: hashes may collide.
    """
    size = F.length("form")
    # A form one letter short of long has long neighbours.
    table = keep(flagged.where(size >= LONG_WORD - 1).withColumn("id", F.unhex(F.sha2("form", 256))), "long")
    rows = table.select("form", "accepted")
    accepted, long = rows.where("accepted"), rows.where(size >= LONG_WORD)
    asking = lengths.with_accepted(long, 0)

    def meet(mine: DataFrame, theirs: DataFrame, on: list[str], kind: str) -> DataFrame:
        held = keep(theirs.withColumnsRenamed({"id": "other", "place": "theirs"}), "hashes")
        # Each key is in few rows, so neither side is copied.
        return mine.join(held, on).where("id <> other").select(
            "id", "other", F.greatest("place", "theirs").alias("place"), F.lit(kind).alias("kind"))

    substituted = letterhash.substitution_keys
    held = _hash_keys(lengths.asked(accepted.where(size >= LONG_WORD), 0), substituted)
    met = _hash_keys(asking, substituted).join(
        keep(held.withColumnRenamed("id", "other"), "hashes"), ["size", "place", "key"]).where(
            "id <> other").select("id", "other", "place", F.lit("substitution").alias("kind"))
    if other_length:
        dropped = lambda rows: _hash_keys(rows, letterhash.deletion_keys, 1)
        met = met.unionByName(meet(dropped(lengths.with_accepted(long, -1)), _whole_keys(accepted),
                                   ["size", "key"], "deletion"))
        met = met.unionByName(meet(_whole_keys(lengths.with_accepted(rows, 1)), dropped(
            lengths.asked(accepted.where(size >= LONG_WORD), -1)), ["size", "key"], "insertion"))
    if transpositions:
        met = met.unionByName(meet(_hash_keys(asking, letterhash.swap_keys), _whole_keys(accepted),
                                   ["size", "key"], "swap"))
    a, b, at = F.col("form"), F.col("neighbour"), F.col("place")
    start, rest = F.lit(1), F.greatest(F.length("form"), F.length("neighbour"))
    without = lambda word: F.concat(F.substring(word, start, at - 1), F.substring(word, at + 1, rest))
    swapped = F.concat(F.substring(a, start, at - 1), F.substring(a, at + 1, start), F.substring(a, at, start),
                       F.substring(a, at + 2, rest))
    same = (F.when(F.col("kind") == "substitution", without(a) == without(b))
            .when(F.col("kind") == "deletion", without(a) == b)
            .when(F.col("kind") == "insertion", without(b) == a).otherwise(swapped == b))
    theirs = table.select(F.col("id").alias("other"), F.col("form").alias("neighbour"), "frequency")
    return (keep(met, "met").join(table.select("id", "form"), "id").join(theirs, "other")
            .where(same).select("form", "neighbour", "frequency"))


def _with_long(counts: DataFrame, flagged: DataFrame, lengths: _Lengths, *options: bool) -> DataFrame:
    """(form, n) rows together with those of long forms, if there are any."""
    if lengths.longest() < LONG_WORD:
        return counts
    pairs = _long_pairs(flagged, lengths, *options)
    return counts.unionByName(pairs.select("form", F.lit(1).cast("long").alias("n")))


def hamming_hood(flagged: DataFrame, transpositions: bool = False) -> DataFrame:
    """(form, hood): accepted other forms of the same length one letter away.

    With ``transpositions`` a swap of two adjacent letters counts as one step too.
    """
    lengths = _Lengths(flagged)
    counts = _substitution_counts(flagged, lengths)
    if transpositions:
        counts = counts.unionByName(_keyed_counts(
            lengths.with_accepted(_short(flagged), 0), swaps(F.col("form")), _short(flagged.where("accepted"))))
    counts = _with_long(counts, flagged, lengths, False, transpositions)
    return counts.groupBy("form").agg(F.sum("n").alias("hood"))


def hamming_pairs(flagged: DataFrame, transpositions: bool = False) -> DataFrame:
    """(form, neighbour) for every accepted form of the same length one letter away.

    Where few forms are accepted, their keys are broadcast and the others do not move.
    """
    form, lengths = F.col("form"), _Lengths(flagged)
    accepted = _short(flagged.where("accepted"))
    asking = lengths.with_accepted(_short(flagged), 0)
    theirs = lengths.asked(accepted, 0).select(form.alias("neighbour"))
    held = keep(theirs.select("neighbour", F.explode(wildcard_patterns(F.col("neighbour"))).alias("key")), "keys")
    pairs = _meet(asking.select("form", F.explode(wildcard_patterns(form)).alias("key")), held, "key").where(
        form != F.col("neighbour"))
    if transpositions:
        # The word with two letters swapped back: keys come from the few.
        swapped = keep(theirs.select("neighbour", F.explode(swaps(F.col("neighbour"))).alias("key")), "keys")
        pairs = pairs.unionByName(_meet(asking.select("form", form.alias("key")), swapped, "key"))
    pairs = pairs.select("form", "neighbour")
    if lengths.longest() < LONG_WORD:
        return pairs
    rows = flagged.select("form", F.lit(0).cast("long").alias("frequency"), "accepted")
    return pairs.unionByName(_long_pairs(rows, lengths, False, transpositions).select("form", "neighbour"))


def edit1_counts(flagged: DataFrame, transpositions: bool = False) -> DataFrame:
    """(form, neighbours): accepted other forms within edit distance one."""
    lengths = _Lengths(flagged)
    accepted, short = _short(flagged.where("accepted")), _short(flagged)
    counts = (_substitution_counts(flagged, lengths)
              .unionByName(_keyed_counts(lengths.with_accepted(short, -1), deletions(F.col("form")), accepted))
              .unionByName(_insertion_counts(flagged, lengths)))
    if transpositions:
        counts = counts.unionByName(_keyed_counts(
            lengths.with_accepted(short, 0), swaps(F.col("form")), accepted))
    counts = _with_long(counts, flagged, lengths, True, transpositions)
    return counts.groupBy("form").agg(F.sum("n").alias("neighbours"))


def edit1_neighbours(flagged: DataFrame, transpositions: bool = False) -> DataFrame:
    """(form, neighbour, frequency) for every accepted form within edit distance one.

    Substitutions, deletions, insertions and swaps cannot give the same pair twice.
    """
    form, lengths = F.col("form"), _Lengths(flagged)
    accepted, short = _short(flagged.where("accepted")), _short(flagged)
    targets = keep(accepted.select(form.alias("neighbour"), "frequency"), "targets")
    neighbour = F.col("neighbour")

    def answering(shift: int, keys) -> DataFrame:
        rows = lengths.asked(accepted, shift).select(form.alias("neighbour"), "frequency")
        return keep(rows.select("neighbour", "frequency", F.explode(keys(neighbour)).alias("key")), "keys")

    asking = lengths.with_accepted(short, 0)
    pairs = (_meet(asking.select("form", F.explode(wildcard_patterns(form)).alias("key")),
                   answering(0, wildcard_patterns), "key").where(form != neighbour))
    whole = targets.withColumn("key", neighbour)
    pairs = pairs.unionByName(
        _meet(lengths.with_accepted(short, -1).select("form", F.explode(deletions(form)).alias("key")),
              whole, "key"))
    pairs = pairs.unionByName(
        _meet(lengths.with_accepted(short, 1).select("form", form.alias("key")),
              answering(-1, deletions), "key"))
    if transpositions:
        pairs = pairs.unionByName(
            _meet(asking.select("form", F.explode(swaps(form)).alias("key")), whole, "key"))
    pairs = pairs.select("form", "neighbour", "frequency")
    if lengths.longest() < LONG_WORD:
        return pairs
    return pairs.unionByName(_long_pairs(flagged, lengths, True, transpositions))
