"""Searching a stored lexicon.

A search is one scan of the ``wide`` table: the conditions reach Parquet, only the
shown columns are read, and a top-k needs no shuffle before its final merge. A lexicon opened with
indexes finds letters inside forms, and the words of a list, through these instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexloom.functions.feats import EMPTY
from lexloom.functions.predicates import ALIASES, Condition, all_of, check, columns_of, names_auxiliary
from lexloom.operators.indexed import candidate_forms, is_long, with_long_list
from lexloom.operators.lookup import lookup_join
from lexloom.sources.store import Lexicon
from lexloom.storage import keep

# Columns with another name in results.
SHOWN_AS = {"nouncase": "case", "nnumber": "number"}

ROW_KEY = ["lemma", "form", "pos", "feats"]
LEMMA_COLUMNS = ["lemmalen", "lemmafreq", "amblemma"]
GRAM_COLUMNS = ["bigramfreq", "initgramfreq", "fingramfreq"]
# Columns whose total makes a relative frequency.
FREQUENCY_COLUMNS = ["lemmafreq", "frequency", "bigramfreq", "initgramfreq", "fingramfreq"]


def _view(lexicon: Lexicon, raw: bool, wide: DataFrame | None = None) -> DataFrame:
    """The wide rows (or those of a copy) under their result meaning of ``pos`` and ``frequency``.

    Normally verbs and auxiliaries are one class with a combined frequency and one
    row per pair; ``raw`` keeps them apart.
    """
    wide = lexicon["wide"] if wide is None else wide
    if raw:
        return wide.drop("frequencyx", "primary")
    return (wide.where("primary").drop("pos", "frequency", "primary")
            .withColumnsRenamed({"posx": "pos", "frequencyx": "frequency"}))


def _columns(df: DataFrame) -> dict[str, Column]:
    """Search key -> column, for wide rows and for results with renamed features."""
    columns = {name: F.col(name) for name in df.columns}
    for key, shown in SHOWN_AS.items():
        if shown in columns:
            columns[key] = columns[shown]
    return columns


def matching(lexicon: Lexicon, conditions: Iterable[Any]) -> DataFrame:
    """All wide rows that meet the conditions, unordered and unlimited."""
    checked, _top = check(conditions, lexicon.features)
    if not checked:
        raise ValueError("no conditions given")
    raw = names_auxiliary(checked)
    candidates = candidate_forms(lexicon.indexes.grams, checked) if lexicon.indexes else None
    if candidates is None:
        rows = _view(lexicon, raw)
    else:
        # The copy in buckets of forms stays in place.
        rows = _view(lexicon, raw, lexicon.indexes.bucketed["form"].join(candidates, "form", "left_semi"))
    plain = [c for c in checked if not is_long(c)]
    rows = rows.where(all_of(plain, _columns(rows), lexicon.totals))
    for condition in checked:
        if is_long(condition):
            rows = with_long_list(rows, lexicon["forms"], condition)
    return rows


def result_columns(features: Mapping[str, str], lemmas: bool = True, grams: bool = True) -> list[Column]:
    """The columns of a search result, in order."""
    names = ["lemma", *(LEMMA_COLUMNS if lemmas else []), "form", "pos", "len", "hood", "ambform",
             "frequency", *(GRAM_COLUMNS if grams else []), "feats", *features.values()]
    return [F.col(name).alias(SHOWN_AS.get(name, name)) for name in names]


def _shown(key: str) -> str:
    """The result column behind a search key or column name."""
    name = ALIASES.get(key, key)
    return SHOWN_AS.get(name, name)


def _ordering(order_by: str, ascending: bool) -> list[Any]:
    """The asked order; the row key settles ties."""
    first = F.col(_shown(order_by))
    return [first.asc() if ascending else first.desc(), *ROW_KEY]


def search(lexicon: Lexicon, conditions: Iterable[Any], order_by: str = "frequency",
           ascending: bool = False, limit: int | None = None,
           lemmas: bool = True, grams: bool = True, ordered: bool = True) -> DataFrame:
    """Rows that meet the conditions, most frequent first by default; all, or the first ``limit``.

    With ``ordered`` false and no limit they come as they are, which saves a sort of the whole result.
    """
    rows = matching(lexicon, conditions).select(result_columns(lexicon.features, lemmas, grams))
    if _shown(order_by) not in rows.columns:
        raise ValueError(f"cannot order by '{order_by}': the result has no such column")
    return _first(rows, _ordering(order_by, ascending), limit, ordered)


def _first(rows: DataFrame, order: list[Any], limit: int | None, ordered: bool) -> DataFrame:
    if limit is None:
        return rows.orderBy(order) if ordered else rows
    return rows.orderBy(order).limit(limit)


def search_wordlist(lexicon: Lexicon, items: DataFrame, kind: str, limit: int | None = None,
                    lemmas: bool = True, grams: bool = True, ordered: bool = True) -> DataFrame:
    """Rows of the listed words (``item``, ``position``), with their list position first.

    ``kind`` is ``form`` or ``lemma``; lemmas match without compound separators. An
    item given twice keeps its last position. ``limit`` and ``ordered`` are as in ``search``.

    With indexes the list goes to the buckets of the search table's copy, and only the list moves.
    """
    if kind not in ("form", "lemma"):
        raise ValueError(f"a word list holds forms or lemmas, not '{kind}'")
    key = "lemmac" if kind == "lemma" else "form"
    listed = items.groupBy(F.col("item").alias(key)).agg(F.max("position").alias("order"))
    if lexicon.indexes:
        rows = _view(lexicon, False, lexicon.indexes.bucketed[key]).join(listed, key)
    else:
        rows = lookup_join(_view(lexicon, raw=False), keep(listed, "wordlist"), [key], "inner")
    rows = rows.select("order", *result_columns(lexicon.features, lemmas, grams))
    return _first(rows, _ordering("frequency", False), limit, ordered)


def refilter(lexicon: Lexicon, result: DataFrame, conditions: Iterable[Any]) -> DataFrame:
    """Narrow an earlier result; ``("top", "=", N)`` keeps the N best rows of each form.

    A frequency that the result only shows per million is compared by that.
    """
    checked, top = check(conditions, lexicon.features, _columns(result))
    out = result.where(all_of(checked, _columns(result), lexicon.totals))
    return out if top is None or top <= 0 else top_per_form(out, top)


def top_per_form(result: DataFrame, n: int) -> DataFrame:
    """At most the ``n`` most frequent rows of each form.

    Spark cuts every partition to ``n`` rows per form before the shuffle, so a form
    with very many rows stays cheap.
    """
    frequency = "frequency" if "frequency" in result.columns else "relfrequency"
    ties = [name for name in ("lemma", "pos", "feats") if name in result.columns]
    best = Window.partitionBy("form").orderBy(F.col(frequency).desc(), *ties)
    return result.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= n).drop("_rank")


def aggregate(lexicon: Lexicon, keys: Sequence[str], operator: str = "sum",
              conditions: Iterable[Any] = (), limit: int | None = None) -> DataFrame:
    """Frequency sum or row count by word and feature keys, largest first; all or ``limit`` groups.

    ``agg`` is the result column. A verb and its auxiliary twin count once.
    """
    names = [ALIASES.get(key, key) for key in keys]
    allowed = {"lemma", "form", "pos", "posx", *lexicon.features.values()}
    errors = [f"cannot group by '{key}': it is no word or feature key" for key, name in zip(keys, names)
              if name not in allowed]
    if operator not in ("sum", "count"):
        errors.append(f"'{operator}' does not aggregate: choose sum or count")
    if not names:
        errors.append("name at least one key to group by")
    if errors:
        raise ValueError("\n".join(errors))
    conditions = list(conditions)
    checked = check(conditions, lexicon.features)[0] if conditions else []
    stored = _stored_sums(lexicon, names, checked)
    if stored is not None:
        total = F.sum("frequency" if operator == "sum" else "rows").cast("long").alias("agg")
        group = [(F.col("pos") if name == "posx" else F.col(name)).alias(_shown(name)) for name in names]
        return _first(stored.groupBy(group).agg(total), [F.col("agg").desc(), *map(_shown, names)], limit, True)
    rows = matching(lexicon, conditions) if conditions else _view(lexicon, raw=False)
    if "posx" in names:
        rows = rows.withColumn("posx", F.when(F.col("pos") == "AUX", "VERB").otherwise(F.col("pos")))
    group = [F.col(name).alias(_shown(name)) for name in names]
    measure = F.sum("frequency") if operator == "sum" else F.count("frequency")
    return _first(rows.groupBy(group).agg(measure.alias("agg")),
                  [F.col("agg").desc(), *map(_shown, names)], limit, True)


def _stored_sums(lexicon: Lexicon, names: Sequence[str], checked: Sequence[Condition]) -> DataFrame | None:
    """The smallest stored sums that hold all keys and all that is asked of the rows, if there are any."""
    if not lexicon.indexes or names_auxiliary(checked) or any(map(is_long, checked)):
        return None
    needed = {"posx" if name == "pos" else name for name in names} | set(map(columns_of, checked))
    sums = lexicon.indexes.smallest(needed)
    if sums is None:
        return None
    sums = sums.withColumnsRenamed({"posx": "pos", "frequencyx": "frequency"})
    return sums.where(all_of(checked, _columns(sums), lexicon.totals))


def relative_frequencies(lexicon: Lexicon, result: DataFrame, scale: float = 1e6,
                         drop: bool = False) -> DataFrame:
    """Add ``rel*`` columns, per million by default, each after its source column.

    With ``drop`` the source columns are left out.
    """
    columns: list[Column] = []
    for name in result.columns:
        if name not in FREQUENCY_COLUMNS:
            columns.append(F.col(name))
            continue
        if not drop:
            columns.append(F.col(name))
        columns.append((F.col(name) / F.lit(lexicon.totals[name]) * F.lit(scale)).alias(f"rel{name}"))
    return result.select(columns)


def column_groups(result: DataFrame, lemma: bool = True, form: bool = True, grams: bool = True,
                  features: bool = True, frequencies: str = "both") -> DataFrame:
    """Choose column groups and ``absolute``, ``relative`` or ``both`` frequencies.

    A group reaches from its first column to that of the next group; columns before
    all groups always stay.
    """
    if frequencies not in ("absolute", "relative", "both"):
        raise ValueError(f"show absolute, relative or both frequencies, not '{frequencies}'")
    starts = {"lemma": lemma, "form": form, "bigramfreq": grams, "relbigramfreq": grams,
              "feats": features}
    shown, chosen = True, []
    for name in result.columns:
        shown = starts.get(name, shown)
        relative = name.removeprefix("rel") in FREQUENCY_COLUMNS and name.startswith("rel")
        if (frequencies == "absolute" and relative) or (
                frequencies == "relative" and name in FREQUENCY_COLUMNS):
            continue
        if shown:
            chosen.append(name)
    return result.select(chosen)


def drop_empty_columns(result: DataFrame) -> DataFrame:
    """Leave out text columns that are ``_`` in every row.

    One aggregate over the result finds them; a single row of flags comes back.
    """
    texts = [name for name, kind in result.dtypes if kind == "string"]
    flags = result.agg(*[F.every(F.col(name) == EMPTY).alias(name) for name in texts]).first()
    return result.drop(*[name for name in texts if flags[name]])
