"""Searches through the indexes of a lexicon."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, functions as F

from lexloom.functions.predicates import FORM_KEYS, LOWER, UPPER, Condition, all_of

#: Lists of more values than this are joined as a table instead of standing in the plan one by one.
LONG_LIST = 200
#: Keys whose long lists are joined, and the column behind them.
LISTED_KEYS = {"form": "form", "lemma": "lemma", "lemmac": "lemmac"}
AFFIXES = ("start", "end")


def _trigrams(text: str) -> set[str]:
    return {text[i:i + 3] for i in range(len(text) - 2)}


def required_grams(condition: Condition) -> list[set[str]] | None:
    """For each value of a condition the trigrams a form must have; none if some value has none.

    ``^`` and ``$`` mark the form's beginning and end. Only conditions that ask for letters can be
    answered: ``start``, ``end`` and ``middle``, and ``like`` on the form.
    """
    fold = str.maketrans(UPPER, LOWER)
    if condition.key in FORM_KEYS and condition.operator in ("=", "in"):
        before, after = {"start": ("^", ""), "end": ("", "$"), "middle": ("", "")}[condition.key]
        found = [_trigrams(before + value.translate(fold) + after) for value in condition.value]
    elif condition.key == "form" and condition.operator == "like":
        pieces = re.split("[%_]", f"^{condition.value[0].translate(fold)}$")
        found = [set().union(*map(_trigrams, pieces))]
    else:
        return None
    return found if found and all(found) else None


def candidate_forms(grams: DataFrame, conditions: Iterable[Condition]) -> DataFrame | None:
    """(form) with all that the indexed conditions ask for; none if no condition can use the index.

    Only the rows of the trigrams asked for are read. They are intersected by form, then the forms are
    held against the conditions themselves.
    """
    usable = [(c, needed) for c in conditions if (needed := required_grams(c))]
    if not usable:
        return None
    wanted = sorted(set().union(*(g for _, needed in usable for g in needed)))
    rows = grams.where(F.col("gram").isin(wanted))
    if len(wanted) > 1:
        rows = rows.groupBy("form").agg(F.collect_set("gram").alias("held"))
        has = lambda needed: F.size(F.array_intersect("held", F.array(*map(F.lit, sorted(needed))))) == len(needed)
        rows = rows.where(reduce(and_, [reduce(or_, map(has, needed)) for _, needed in usable]))
    return rows.select("form").where(all_of([c for c, _ in usable], {"form": F.col("form")}, {}))


def is_long(condition: Condition) -> bool:
    """Whether a condition's list is joined."""
    return (condition.operator in ("in", "not in") and len(condition.value) > LONG_LIST
            and condition.key in (*LISTED_KEYS, *AFFIXES))


def with_long_list(rows: DataFrame, forms: DataFrame, condition: Condition) -> DataFrame:
    """Rows that meet a condition with a long list, by semi- or anti-joins with the list as a table.

    Words meet their column. Affixes are grouped by length: a form shows its affix of each length that
    occurs, and a form that meets one is listed; the plan has the same size for any list.
    """
    spark, values = rows.sparkSession, list(dict.fromkeys(condition.value))
    how = "left_semi" if condition.operator == "in" else "left_anti"
    listed = spark.createDataFrame([(v,) for v in values], "value string")
    if condition.key in LISTED_KEYS:
        column = LISTED_KEYS[condition.key]
        return rows.join(listed.withColumnRenamed("value", column), column, how)
    form = F.col("form")
    cut = (lambda n: F.substring(form, 1, n)) if condition.key == "start" else (lambda n: F.right(form, F.lit(n)))
    lengths = sorted({len(v) for v in values})
    affixes = F.array(*[F.when(F.length(form) >= n, cut(n)) for n in lengths])
    found = forms.select("form", F.explode(F.array_compact(affixes)).alias("value")).join(
        listed, "value", "left_semi").select("form").distinct()
    return rows.join(found, "form", how)
