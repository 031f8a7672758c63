"""Typed search conditions.

A condition is ``(key, operator, value)``, for example ``("len", ">=", 6)`` or
``("start", "in", ["au", "ta"])``; ``"compound"`` and ``"not compound"`` stand alone.
A list of conditions must hold together. Values are matched in the case the lexicon
uses: word classes upper, feature values title, words lower.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from operator import and_, eq, ge, gt, le, lt, ne, or_
from typing import Any

from pyspark.sql import Column, functions as F

from lexloom.functions.feats import EMPTY
from lexloom.functions.grams import LOWER, UPPER
from lexloom.functions.words import is_compound, without_separator
from lexloom.languages import MULTI_VALUE_COLUMNS

# Search keys, their short forms and operators.
NUMERIC_KEYS = ("frequency", "len", "lemmafreq", "lemmalen", "amblemma", "hood", "ambform",
                "initgramfreq", "fingramfreq", "bigramfreq")
FRACTION_KEYS = ("amblemma", "ambform")
RELATIVE_KEYS = tuple(f"rel{key}" for key in NUMERIC_KEYS if "freq" in key)
STRING_KEYS = ("lemma", "lemmac", "form", "pos")
FORM_KEYS = ("start", "middle", "end")
ALIASES = {
    "freq": "frequency", "relfreq": "relfrequency",
    "case": "nouncase", "number": "nnumber",
    "lemmafrequency": "lemmafreq", "rellemmafrequency": "rellemmafreq",
    "initrigramfreq": "initgramfreq", "fintrigramfreq": "fingramfreq",
    "relinitrigramfreq": "relinitgramfreq", "relfintrigramfreq": "relfingramfreq",
}
NUMERIC_OPERATORS = {"=": eq, "!=": ne, "<": lt, ">": gt, "<=": le, ">=": ge}
STRING_OPERATORS = ("=", "!=", "like", "not like", "in", "not in")
FORM_OPERATORS = ("=", "!=", "in", "not in")
PER_MILLION = 1e6
LONG = 2.0 ** 63


@dataclass(frozen=True)
class Condition:
    key: str
    operator: str
    value: Any


def _values(value: Any) -> list[str]:
    parts = value.split(",") if isinstance(value, str) else list(value)
    return [str(part).strip() for part in parts]


def _in_case(key: str, value: str) -> str:
    if key == "pos":
        return value.upper()
    if key in STRING_KEYS or key in FORM_KEYS:
        return value.lower()
    return value.title()


def _missing(key: str, columns: Mapping[str, Any]) -> bool:
    """Whether a result lacks what a checked key is compared with."""
    if key in ("compound", "lemmac", "lemma"):
        return not {"lemma", "lemmac"} & set(columns) if key == "lemmac" else "lemma" not in columns
    if key in FORM_KEYS:
        return "form" not in columns
    if key in RELATIVE_KEYS or key in NUMERIC_KEYS:
        plain = key.removeprefix("rel")
        return plain not in columns and f"rel{plain}" not in columns
    if key == "top":
        return "form" not in columns or not {"frequency", "relfrequency"} & set(columns)
    return key not in columns


def check(conditions: Iterable[Any], features: Mapping[str, str],
          available: Mapping[str, Any] | None = None) -> tuple[list[Condition], int | None]:
    """Checked conditions, and the N of a ``("top", "=", N)`` entry.

    ``available`` are the columns of a result to be searched (default: all). All mistakes are
    reported in one ``ValueError``.
    """
    columns = set(features.values())
    checked: list[Condition] = []
    errors: list[str] = []
    top = None

    conditions = list(conditions)
    if not conditions:
        raise ValueError("no conditions given")
    for given in conditions:
        if isinstance(given, str):
            words = given.lower().split()
            if words in (["compound"], ["not", "compound"]):
                checked.append(Condition("compound", "=", len(words) == 1))
            else:
                errors.append(f"no condition: '{given}'")
            continue
        if not isinstance(given, (tuple, list)) or len(given) != 3:
            errors.append(f"no condition: '{given}'")
            continue
        key, operator, value = given
        key = ALIASES.get(str(key).lower(), str(key).lower())
        operator = " ".join(str(operator).lower().split())
        bad_operator = f"'{key}' cannot be compared by '{operator}'"

        if key in NUMERIC_KEYS or key in RELATIVE_KEYS or key == "top":
            if operator not in (NUMERIC_OPERATORS if key != "top" else ("=",)):
                errors.append(bad_operator)
                continue
            try:
                number = float(value)
            except (TypeError, ValueError, OverflowError):
                number = math.nan
            if not math.isfinite(number):
                errors.append(f"'{key}' is compared with numbers, and '{value}' is none")
                continue
            if key == "top":
                top = int(number)
            else:
                checked.append(Condition(key, operator, number))
        elif key in FORM_KEYS:
            if operator in FORM_OPERATORS:
                checked.append(Condition(key, operator, [_in_case(key, v) for v in (
                    _values(value) if "in" in operator else [str(value)])]))
            else:
                errors.append(bad_operator)
        elif key in STRING_KEYS or key in columns:
            if operator in STRING_OPERATORS:
                if key == "lemma" and "like" not in operator:
                    key = "lemmac"
                checked.append(Condition(key, operator, [_in_case(key, v) for v in (
                    _values(value) if operator in ("in", "not in") else [str(value)])]))
            else:
                errors.append(bad_operator)
        else:
            errors.append(f"there is no search key '{key}'")
    if available is not None:
        wanted = [c.key for c in checked] + (["top"] if top is not None else [])
        errors += [f"the result has no column for '{key}'" for key in dict.fromkeys(wanted)
                   if _missing(key, available)]
    if errors:
        raise ValueError("\n".join(errors))
    return checked, top


def names_auxiliary(conditions: Iterable[Condition]) -> bool:
    """Whether a word-class condition names AUX, so that it differs from VERB."""
    return any(c.key == "pos" and "AUX" in c.value for c in conditions)


def _like(column: Column, pattern: str) -> Column:
    """SQL LIKE, blind to ASCII case; only ``%`` and ``_`` are special."""
    folded = pattern.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\")
    return F.translate(column, UPPER, LOWER).like(folded)


def numeric(column: Column, operator: str, number: float, fraction: bool = False) -> Column:
    """Compare with a number. Whole-number columns meet a whole number, so that the
    test reaches Parquet: above 7.3 is above 7, and nothing equals 7.3."""
    if fraction:
        return NUMERIC_OPERATORS[operator](column, F.lit(number))
    if not -LONG <= number < LONG:  # beyond all values of the column
        return column.isNotNull() & F.lit(NUMERIC_OPERATORS[operator](0.0, number))
    below = math.floor(number)
    if below != number:
        if operator in ("=", "!="):
            return F.lit(operator == "!=")
        operator = "<=" if operator.startswith("<") else ">"
    return NUMERIC_OPERATORS[operator](column, F.lit(below))


def string(column: Column, operator: str, values: list[str]) -> Column:
    """``=``, ``!=``, ``in``, ``not in``, ``like`` and ``not like`` on a text column."""
    if operator.endswith("in"):
        found = column.isin(values)
    elif operator.endswith("like"):
        found = _like(column, values[0])
    else:
        found = column == values[0]
    return ~found if operator in ("!=", "not in", "not like") else found


def multi_value(column: Column, operator: str, values: list[str]) -> Column:
    """Like ``string``, but ``=``, ``in`` and ``like`` match any single value of a feature.

    The empty mark and all negations compare the whole string.
    """
    if operator in ("!=", "not in") or (operator in ("=", "in") and values == [EMPTY]):
        return string(column, operator, values)
    single = F.split(column, ",")
    if operator.endswith("like"):
        found = (column != EMPTY) & F.exists(single, lambda v: _like(v, values[0]))
        return ~found if operator == "not like" else found
    wanted = [v for v in values if v != EMPTY]
    return F.arrays_overlap(single, F.array(*map(F.lit, wanted)))


def within_form(column: Column, key: str, operator: str, values: list[str]) -> Column:
    """``start``, ``end`` and ``middle``; the middle has a letter on either side."""
    def one(value: str) -> Column:
        text = F.lit(value)
        if key == "start":
            return F.startswith(column, text)
        if key == "end":
            return F.endswith(column, text)
        inner = F.substring(column, F.lit(2), F.greatest(F.length(column) - 2, F.lit(0)))
        return F.contains(inner, text)

    found = reduce(or_, [one(value) for value in values])
    return ~found if operator in ("!=", "not in") else found


def condition_column(condition: Condition, columns: Mapping[str, Column],
                     totals: Mapping[str, int]) -> Column:
    """One condition as a Column; ``columns`` gives the column behind each key."""
    key, operator, value = condition.key, condition.operator, condition.value
    if key == "compound":
        found = is_compound(columns["lemma"])
        return found if value else ~found
    if key in RELATIVE_KEYS:
        if key.removeprefix("rel") not in columns:
            return NUMERIC_OPERATORS[operator](columns[key], F.lit(value))
        key = key.removeprefix("rel")
        return numeric(columns[key], operator, value / PER_MILLION * totals[key])
    if key in NUMERIC_KEYS and key not in columns:
        return NUMERIC_OPERATORS[operator](columns[f"rel{key}"], F.lit(value * PER_MILLION / totals[key]))
    if key in NUMERIC_KEYS:
        return numeric(columns[key], operator, value, key in FRACTION_KEYS)
    if key in FORM_KEYS:
        return within_form(columns["form"], key, operator, value)
    if key == "lemmac":
        return string(columns.get("lemmac", without_separator(columns["lemma"])), operator, value)
    if key == "pos" and "AUX" not in value and "posx" in columns:
        return string(columns["posx"], operator, value)
    if key in MULTI_VALUE_COLUMNS:
        return multi_value(columns[key], operator, value)
    return string(columns[key], operator, value)


def columns_of(condition: Condition) -> str:
    """The stored column that a condition on the default view is held against."""
    key = condition.key.removeprefix("rel") if condition.key in RELATIVE_KEYS else condition.key
    return {"compound": "lemma", "pos": "posx", "frequency": "frequencyx", **dict.fromkeys(FORM_KEYS, "form")}.get(key, key)


def all_of(conditions: Iterable[Condition], columns: Mapping[str, Column],
           totals: Mapping[str, int]) -> Column:
    """All conditions together."""
    return reduce(and_, [condition_column(c, columns, totals) for c in conditions], F.lit(True))
