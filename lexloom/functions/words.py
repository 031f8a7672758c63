"""Expressions on words and lemmas."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The letters a word may be built from.
LETTERS = "abcdefghijklmnopqrstuvwxyzåäöüáàãâéèêíìïóòôõúñç"

# First a letter or digit, inside also '.:-_#, last a letter, digit, hyphen,
# full stop or apostrophe.
WORD_SHAPE = f"^[{LETTERS}0-9]['.:\\-_#{LETTERS}0-9]*[{LETTERS}0-9\\-.']\\z"
HAS_LETTER = f"[{LETTERS}]"

# Stands for "any character here"; cannot occur in a valid word.
WILDCARD = "*"


def valid_word(word: Column) -> Column:
    """True for words of two or more characters with a valid shape and a letter."""
    return word.rlike(WORD_SHAPE) & word.rlike(HAS_LETTER)


def posx(pos: Column) -> Column:
    """Word class with auxiliaries counted as verbs."""
    return F.when(pos == "AUX", F.lit("VERB")).otherwise(pos)


def without_separator(lemma: Column) -> Column:
    """Lemma without its compound separators."""
    return F.replace(lemma, F.lit("#"), F.lit(""))


def compound_parts(lemma: Column) -> Column:
    """Number of compound separators in a lemma."""
    return F.length(lemma) - F.length(without_separator(lemma))


def is_compound(lemma: Column) -> Column:
    return F.contains(lemma, F.lit("#"))
