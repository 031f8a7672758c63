"""Letter-group expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from lexloom.functions.words import WILDCARD

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bigrams(word: Column) -> Column:
    """Adjacent letter pairs, repeats kept; empty for a one-letter word."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(word) - 1),
                        lambda i: F.substring(word, i, F.lit(2)))
    return F.when(F.length(word) > 1, pairs).otherwise(F.array().cast("array<string>"))


def bigram_mean(word: Column, alphabet: str, table: Sequence[int]) -> Column:
    """Mean frequency of a word's letter pairs, rounded down; null for a one-letter word.

    ``table`` holds the frequency of each pair of letters of ``alphabet``, first letter by first letter.
    The row alone decides, so nothing is joined or shuffled.
    """
    held = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")
    letter = lambda i: F.position(F.substring(word, i, F.lit(1)), F.lit(alphabet)) - 1
    pairs = F.length(word) - 1
    total = F.aggregate(F.sequence(F.lit(1), pairs), F.lit(0).cast("long"), lambda acc, i: acc + F.coalesce(
        F.get(held, letter(i) * len(alphabet) + letter(i + 1)), F.lit(0)))
    return F.when(pairs > 0, F.floor(total / pairs))


def has_trigrams(word: Column) -> Column:
    """Only words of four letters or more count at the word edges."""
    return F.length(word) >= 4


def marked_trigrams(word: Column) -> Column:
    """The distinct trigrams of a word between marks for its beginning and end, A-Z as a-z."""
    text = F.concat(F.lit("^"), F.translate(word, UPPER, LOWER), F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))),
                                        lambda i: F.substring(text, i, F.lit(3))))


def initial_trigram(word: Column) -> Column:
    return F.substring(word, 1, 3)


def final_trigram(word: Column) -> Column:
    return F.right(word, F.lit(3))


# Words of this length or more meet on hashes (see ``letterhash``), shorter ones on the keys themselves.
LONG_WORD = 64


def _keys(last: Column, make) -> Column:
    """Keys made at positions 1 to ``last``."""
    return F.transform(F.sequence(F.lit(1), last), lambda i: make(i))


def wildcard_patterns(word: Column) -> Column:
    """The word with each letter in turn replaced by a wildcard."""
    return _keys(F.length(word), lambda i: F.overlay(word, F.lit(WILDCARD), i, F.lit(1)))


def deletions(word: Column) -> Column:
    """The distinct words left after dropping one letter."""
    size = F.length(word)
    return F.array_distinct(_keys(size, lambda i: F.concat(
        F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, size))))


def swaps(word: Column) -> Column:
    """The distinct other words made by swapping two adjacent letters."""
    size = F.length(word)
    swapped = _keys(size - 1, lambda i: F.concat(
        F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.lit(1)),
        F.substring(word, i, F.lit(1)), F.substring(word, i + 2, size)))
    other = F.array_remove(F.array_distinct(swapped), word)
    return F.when(size > 1, other).otherwise(F.array().cast("array<string>"))
