from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexloom.operators import search as s


def keys(df):
    return {(r.lemma, r.form, r.pos, r.feats) for r in df.select("lemma", "form", "pos", "feats").collect()}


def find(lexicon, *conditions):
    return s.matching(lexicon, conditions)


def test_numbers_split(lexicon):
    low = s.search(lexicon, [("form", "=", "the"), ("ambform", "<", 0.5)])
    high = s.search(lexicon, [("form", "=", "the"), ("ambform", ">", 0.5)])
    assert low.where("ambform >= 0.5").count() == 0 and high.where("ambform <= 0.5").count() == 0
    assert high.where("form != 'the'").count() == 0
    assert low.count() and high.count()


def test_clitics(lexicon):
    some, none = find(lexicon, ("clitic", "!=", "_")), find(lexicon, ("clitic", "=", "_"))
    assert some.count() and some.where("clitic = '_'").count() == 0
    assert none.count() and none.where("clitic != '_'").count() == 0
    assert keys(find(lexicon, ("clitic", "in", "_"))) == keys(none)
    assert keys(find(lexicon, ("clitic", "not in", "_"))) == keys(some)
    assert find(lexicon, ("clitic", "not in", "kin,kaan")).where("clitic = '_'").count()
    unequal = find(lexicon, ("clitic", "!=", "kin"))
    assert unequal.where("clitic = 'Kin'").count() == 0
    assert unequal.where("clitic = 'Han,Kin'").count() and unequal.where("clitic = '_'").count()
    single = find(lexicon, ("clitic", "=", "kin"))
    assert single.where("clitic = 'Kin'").count() and single.where("clitic = 'Han,Kin'").count()
    assert keys(find(lexicon, ("clitic", "in", "_,han"))) == keys(find(lexicon, ("clitic", "=", "han")))


def test_compounds(lexicon):
    compounds = find(lexicon, "compound")
    assert compounds.count() and compounds.where("not contains(lemma, '#')").count() == 0
    assert find(lexicon, "not compound").where("contains(lemma, '#')").count() == 0
    lemma = compounds.first().lemma
    same = find(lexicon, ("lemma", "=", lemma.replace("#", "")))
    assert same.where(F.col("lemma") == lemma).count()


def test_form_parts(lexicon):
    start = keys(find(lexicon, ("start", "=", "th")))
    inside = keys(find(lexicon, ("start", "=", "th"), ("middle", "=", "th")))
    outside = keys(find(lexicon, ("start", "=", "th"), ("middle", "!=", "th")))
    assert start and inside and outside
    assert inside | outside == start and not inside & outside
    assert all(f.startswith("th") for _, f, _, _ in start)
    assert all("th" in f[1:-1] for _, f, _, _ in inside)
    ends = keys(find(lexicon, ("end", "in", "ing,tion")))
    assert ends and all(f.endswith(("ing", "tion")) for _, f, _, _ in ends)
    assert not any(f.endswith(("e", "n")) for _, f, _, _ in keys(find(lexicon, ("end", "not in", ["e", "n"]))))
    assert find(lexicon, ("start", "=", "*")).count() == 0


def test_all_errors_at_once(lexicon):
    with pytest.raises(ValueError) as caught:
        s.search(lexicon, [("nouncase", "in", "ill,gen"), ("foo", "=", 0), ("len", ">", "a"), "naat compound",
                           ("len", "~=", 10), "len<10", ("start", "like", "a")])
    lines = str(caught.value).splitlines()
    for key, value in (("'foo'", ""), ("'len'", "'a'"), ("'naat compound'", ""), ("'len'", "'~='"), ("'len<10'", ""),
                       ("'start'", "'like'")):
        assert any(key in line and value in line for line in lines)
    assert len(lines) == 6
    for nothing in ([], [("top", "=", 2)]):
        with pytest.raises(ValueError):
            s.search(lexicon, nothing)
    with pytest.raises(ValueError):
        s.search(lexicon, [("len", ">", 1)], order_by="nothing")
    with pytest.raises(ValueError):
        s.aggregate(lexicon, ["colour"], "median")


def test_verbs_and_auxiliaries(lexicon):
    verbs = find(lexicon, ("pos", "=", "verb"))
    assert keys(verbs) and {r.pos for r in verbs.select("pos").distinct().collect()} == {"VERB"}
    assert verbs.count() == len(keys(verbs))
    raw = find(lexicon, ("pos", "in", "aux,noun"))
    assert {r.pos for r in raw.select("pos").distinct().collect()} == {"AUX", "NOUN"}
    both = find(lexicon, ("pos", "=", "aux"), ("pos", "=", "verb"))
    assert both.count() == find(lexicon, ("pos", "=", "aux")).count()
    frequency = lexicon["wide"].agg(F.sum("frequency")).first()[0]
    assert find(lexicon, ("frequency", ">", 0)).agg(F.sum("frequency")).first()[0] == frequency


def test_wordlist_and_refilter(spark, lexicon):
    items = spark.createDataFrame([("the", 1), ("and", 2), ("the", 3), ("zzzz", 4)], "item string, position int")
    found = s.search_wordlist(lexicon, items, "form")
    assert found.columns[0] == "order"
    assert {(r.form, r.order) for r in found.collect()} == {("the", 3), ("and", 2)}
    narrowed = s.refilter(lexicon, found, [("form", "=", "the"), ("frequency", ">", 10), ("ambform", "<", 0.9)])
    assert narrowed.count() and "order" in narrowed.columns
    top = s.refilter(lexicon, found, [("top", "=", 1)]).collect()
    assert sorted(r.form for r in top) == ["and", "the"]
    best = {f: max(r.frequency for r in found.collect() if r.form == f) for f in ("and", "the")}
    assert {r.form: r.frequency for r in top} == best
    renamed = s.refilter(lexicon, find(lexicon, ("len", ">", 3)).select(
        s.result_columns(lexicon.features)), [("case", "in", "gen")])
    assert {r["case"] for r in renamed.select("case").distinct().collect()} == {"Gen"}


def test_relative_columns(lexicon):
    result = s.search(lexicon, [("frequency", ">", 3)])
    both = s.relative_frequencies(lexicon, result)
    names = both.columns
    assert names[names.index("frequency") + 1] == "relfrequency"
    row = both.first()
    assert row.relfrequency == row.frequency / lexicon.totals["frequency"] * 1e6
    only = s.relative_frequencies(lexicon, result, drop=True)
    assert "frequency" not in only.columns and "relbigramfreq" in only.columns
    per_million = row.relfrequency
    assert find(lexicon, ("relfreq", ">=", per_million)).count() >= 1
    assert s.column_groups(both, lemma=False, form=False, grams=False).columns[0] == "feats"
    assert "relfrequency" not in s.column_groups(both, frequencies="absolute").columns
    grams_only = s.column_groups(both, lemma=False, form=False, features=False, frequencies="relative")
    assert grams_only.columns == ["relbigramfreq", "relinitgramfreq", "relfingramfreq"]


def test_empty_columns(lexicon):
    result = s.search(lexicon, [("pos", "=", "verb")])
    shown = s.drop_empty_columns(result)
    assert "case" not in shown.columns and "mood" in shown.columns
    nothing = s.search(lexicon, [("form", "=", "no such form")])
    assert s.drop_empty_columns(nothing).columns == nothing.columns


def test_order_and_limit(lexicon):
    rows = s.search(lexicon, [("frequency", ">", 0)], order_by="len", ascending=True, limit=20).collect()
    assert len(rows) == 20 and [r.len for r in rows] == sorted(r.len for r in rows)
    rows = s.search(lexicon, [("frequency", ">", 0)], order_by="case", ascending=True, limit=5).collect()
    assert {r["case"] for r in rows} == {"Gen"}


def test_aggregate_counts_twins_once(lexicon):
    total = s.aggregate(lexicon, ["pos"], "sum").agg(F.sum("agg")).first()[0]
    assert total == lexicon.totals["frequency"]
    rows = s.aggregate(lexicon, ["number", "case"], "count", [("pos", "=", "noun")], limit=3)
    assert rows.columns == ["number", "case", "agg"] and rows.count() == 3


@pytest.mark.parametrize("operator", ["=", "!=", "<", "<=", ">", ">="])
@pytest.mark.parametrize("number", [7, 7.0, 7.3, -0.5])
def test_whole_number_bounds(lexicon, operator, number):
    test = {"=": "=", "!=": "!="}.get(operator, operator)
    expected = lexicon["forms"].where(f"cast(hood as double) {test} cast({number} as double)").count()
    from lexloom.functions.predicates import numeric

    assert lexicon["forms"].where(numeric(F.col("hood"), operator, float(number))).count() == expected


def test_nothing_is_cut_unasked(spark, lexicon):
    everything = [("frequency", ">", 0)]
    n = s.matching(lexicon, everything).count()
    assert n > 10_000 and s.search(lexicon, everything).count() == n
    groups = s.aggregate(lexicon, ["lemma"], "count")
    assert groups.count() == s.matching(lexicon, everything).select("lemma").distinct().count() > 20
    forms = lexicon["forms"].select(F.col("form").alias("item"), F.lit(1).alias("position"))
    assert s.search_wordlist(lexicon, forms, "form").count() == n


def test_refilter_of_partial_results(lexicon):
    """Columns a result lacks are named in one error; relative ones stand in for counts."""
    rows = s.search(lexicon, [("frequency", ">", 2)], lemmas=False, grams=False)
    with pytest.raises(ValueError) as error:
        s.refilter(lexicon, rows, [("lemmafreq", ">", 1), ("bigramfreq", "<", 3), ("len", ">", 1)])
    assert all(f"'{key}'" in str(error.value) for key in ("lemmafreq", "bigramfreq"))
    assert "'len'" not in str(error.value)
    full = s.search(lexicon, [("frequency", ">", 2)])
    relative = s.relative_frequencies(lexicon, full, drop=True)
    conditions = [("frequency", ">", 5), ("relbigramfreq", ">", 100), ("top", "=", 1)]
    key = ["lemma", "form", "pos", "feats"]
    narrowed = s.refilter(lexicon, relative, conditions).select(key).collect()
    assert sorted(narrowed) == sorted(s.refilter(lexicon, full, conditions).select(key).collect())


@pytest.mark.parametrize("value", ["nan", "inf", float("-inf"), 10 ** 400, None])
def test_numbers_that_are_none(lexicon, value):
    with pytest.raises(ValueError, match="number"):
        s.matching(lexicon, [("frequency", "<", value)])
    with pytest.raises(ValueError, match="number"):
        s.refilter(lexicon, s.matching(lexicon, [("len", ">", 0)]), [("top", "=", value)])


def test_numbers_beyond_the_column(lexicon):
    count = lambda *condition: s.matching(lexicon, [condition]).count()
    n = count("frequency", ">", 0)
    assert [count("frequency", op, 1e20) for op in ("<", "<=", "!=", ">", ">=", "=")] == [n, n, n, 0, 0, 0]
    assert [count("frequency", op, -1e20) for op in ("<", ">")] == [0, n]
