"""Expressions on FEATS strings such as ``Case=Nom|Number=Sing``."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

EMPTY = "_"


# A feature that comes again further on in the string.
REPEATED = r"(?<![^|])([^=|]++)=[^|]*+(?=[|](?:[^|]*+[|])*\1=)"


def _or_empty(text: Column) -> Column:
    # Unlike a CASE, this evaluates the text once.
    return F.regexp_replace(text, "^$", EMPTY)


def core_feats(feats: Column, names: Iterable[str]) -> Column:
    """Keep the named features, sorted by name; ``_`` when none is left.

    Of a feature given twice the last value counts.
    """
    names = list(names)
    once = F.regexp_replace(F.coalesce(feats, F.lit(EMPTY)), REPEATED, "")
    core = F.filter(F.split(once, "[|]"), lambda pair: F.substring_index(pair, "=", 1).isin(names))
    return _or_empty(F.array_join(F.sort_array(core), "|"))


def feature_value(feats: Column, name: str) -> Column:
    """Value of one feature in a canonical FEATS string, ``_`` when absent."""
    return _or_empty(F.regexp_extract(feats, f"(?<![^|]){re.escape(name)}=([^|]*)", 1))


def feature_columns(feats: Column, features: dict[str, str]) -> list[Column]:
    """One column per core feature."""
    return [feature_value(feats, name).alias(column) for name, column in features.items()]


def equals_for_underscores(msd: Column) -> Column:
    """Write ``CASE_Nom|NUM_Sg`` as ``CASE=Nom|NUM=Sg``; strings with ``=`` stay."""
    rewritten = F.regexp_replace(msd, "(^|[|])([^_|]*)_", "$1$2=")
    change = (msd != EMPTY) & F.contains(msd, F.lit("_")) & ~F.contains(msd, F.lit("="))
    return F.when(change, rewritten).otherwise(msd)
