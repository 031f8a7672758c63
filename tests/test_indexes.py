"""Searches through indexes give what a scan gives, and read what they should."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexloom.functions.predicates import Condition
from lexloom.operators import indexed, search, words
from lexloom.plans.build import build_lexicon
from lexloom.plans.indexes import build_indexes, open_indexed
from lexloom.sources.store import Lexicon
from lexloom.storage import keep, new_folder
from tests.test_plans import plan


@pytest.fixture(scope="module")
def pair(spark, sf_dir):
    """A lexicon with upper-case forms among others, without and with indexes."""
    from checks import fixture

    tokens = fixture.all_tokens(spark, sf_dir, origcase=True)
    from lexloom.languages import features_for

    plain = build_lexicon(words.count_words(tokens, features_for("fi"), origcase=True), new_folder(spark, "plain"))
    return plain, build_indexes(plain, buckets=4)


def rows_of(df):
    return sorted(map(str, df.select("lemma", "form", "pos", "feats", "frequency", "hood").collect()))


@pytest.mark.parametrize("conditions", [
    [("middle", "=", "ent")], [("middle", "in", ["tion", "ouo", "x"])], [("middle", "in", ["tion", "our"])],
    [("end", "=", "ing")], [("end", "=", "ng"), ("start", "=", "th")], [("start", "=", "t")], [("start", "in", "th,the,zzz")],
    [("form", "like", "%TION%")], [("form", "like", "th%")], [("form", "like", "th_t")], [("form", "like", "t%g")],
    [("form", "like", "the")], [("form", "not like", "%tion%"), ("len", ">", 9)], [("middle", "!=", "the"), ("end", "=", "ed")],
    [("pos", "in", "aux,pron"), ("middle", "=", "ere")], [("form", "like", "%a_d%"), ("middle", "=", "nd")],
    [("end", "=", "zzzzz")], [("form", "like", "%'%")]])
def test_same_rows(pair, conditions):
    plain, with_indexes = pair
    assert rows_of(search.matching(with_indexes, conditions)) == rows_of(search.matching(plain, conditions))


def test_random_letters(pair):
    plain, with_indexes = pair
    forms = [r.form for r in plain["forms"].orderBy("form").limit(3000).collect()]
    rng = random.Random(4)
    for _ in range(6):
        form = rng.choice([f for f in forms if len(f) > 4])
        at = rng.randrange(len(form) - 3)
        key = rng.choice(["start", "middle", "end"])
        value = {"start": form[:4], "end": form[-4:], "middle": form[at:at + 4]}[key]
        assert rows_of(search.matching(with_indexes, [(key, "=", value)])) == rows_of(
            search.matching(plain, [(key, "=", value)]))


@pytest.mark.parametrize("kind,key", [("form", "form"), ("lemma", "lemmac")])
def test_word_list(spark, pair, kind, key):
    plain, with_indexes = pair
    items = keep(plain["wide"].where("hash(form) % 3 = 0").select(F.col(key).alias("item")).distinct().limit(400)
                 .withColumn("position", F.abs(F.hash("item")) % 1000), "items")
    ask = lambda lexicon, **more: search.search_wordlist(lexicon, items, kind, **more).collect()
    assert ask(with_indexes) == ask(plain) and sorted(map(str, ask(with_indexes, ordered=False))) == sorted(map(str, ask(plain)))
    assert ask(with_indexes, limit=20) == ask(plain, limit=20)


def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")


@pytest.fixture
def shuffled(spark):
    """Plans as for large tables: nothing is broadcast."""
    no_broadcast(spark)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def branches(text):
    """The plan's tree from each join's two sides: lines of operators with their depth."""
    return [line for line in text.split("\n\n")[0].splitlines() if "(" in line]


def unmoved(text: str, scan: str) -> bool:
    """Whether no exchange stands between the scan of a table and the join above it."""
    lines = branches(text)
    at = next(i for i, line in enumerate(lines) if scan in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    level = depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            level = depth(line)
            if "Exchange" in line:
                return False
            if "Join" in line:
                return True
    return True


def test_the_index_is_read_in_part_and_the_copy_stays(spark, pair, shuffled):
    text = plan(search.matching(pair[1], [("middle", "=", "tion")]))
    assert "In(gram, [ion,tio])" in text and "by_form" in text
    assert unmoved(text, "Scan parquet spark_catalog.default") and "Bucketed: true" in text
    assert "Exchange" in text  # the candidates move
    # Short values keep the scan of the search table.
    text = plan(search.matching(pair[1], [("middle", "=", "ti")]))
    assert "Exchange" not in text and "by_form" not in text


def test_the_list_moves_alone(spark, pair, shuffled):
    items = keep(spark.createDataFrame([("the", 1)], "item string, position int"), "items")
    for kind in ("form", "lemma"):
        text = plan(search.search_wordlist(pair[1], items, kind, ordered=False))
        assert "SortMergeJoin" in text and unmoved(text, "Scan parquet spark_catalog.default"), text


def test_row_groups_are_skipped(spark, pair):
    """Sorted trigrams: a filter meets few of the files."""
    grams = pair[1].indexes.grams
    bounds = grams.select(F.input_file_name().alias("file"), "gram").groupBy("file").agg(
        F.min("gram").alias("low"), F.max("gram").alias("high")).collect()
    assert len(bounds) > 1 and sum(r.low <= "tio" <= r.high for r in bounds) == 1


def test_a_new_build_takes_the_indexes_away(spark, pair):
    rows = keep(pair[0]["lexicon"].where("len < 6"), "rows")
    path = new_folder(spark, "again")
    build_indexes(build_lexicon(rows, path), buckets=2)
    assert open_indexed(spark, path).indexes and Lexicon.load(spark, path).indexes is None
    fewer = keep(rows.where("len < 5"), "fewer")
    build_lexicon(fewer, path)
    again = open_indexed(spark, path)
    assert again.indexes is None
    again = build_indexes(again, buckets=3)
    assert rows_of(search.matching(again, [("end", "=", "ed")])) == rows_of(
        search.matching(Lexicon.load(spark, path), [("end", "=", "ed")]))


def test_required_trigrams():
    ask = lambda *c: indexed.required_grams(Condition(*c))
    assert ask("start", "=", ["th"]) == [{"^th"}] and ask("end", "in", ["ng", "ing"]) == [{"ng$"}, {"ing", "ng$"}]
    assert ask("middle", "=", ["ti"]) is None and ask("start", "in", ["the", "t"]) is None
    assert ask("form", "like", ["A%b_cde%"]) == [{"cde"}] and ask("form", "like", ["%a%"]) is None
    assert ask("form", "like", ["the"]) == [{"^th", "the", "he$"}]
    assert ask("start", "!=", ["the"]) is None and ask("lemma", "like", ["%tion%"]) is None


@pytest.mark.parametrize("key", ["start", "end", "form", "lemma"])
@pytest.mark.parametrize("operator", ["in", "not in"])
def test_long_lists(spark, pair, monkeypatch, key, operator):
    rng = random.Random(5)
    forms = [r.form for r in pair[0]["forms"].collect()]
    values = [f[:rng.randint(1, 6)] if key == "start" else f[-rng.randint(1, 6):] if key == "end" else f
              for f in rng.sample(forms, 300)] + ["q" * 300]
    conditions = [(key, operator, values), ("len", ">", 3)]
    long = search.matching(pair[0], conditions)
    size = len(plan(long))
    assert size == pytest.approx(len(plan(search.matching(pair[0], [(key, operator, values[:202]), ("len", ">", 3)]))), rel=0.2)
    got = rows_of(long)
    monkeypatch.setattr(indexed, "LONG_LIST", 10_000)
    assert got == rows_of(search.matching(pair[0], conditions))


@pytest.mark.parametrize("keys,operator,conditions,stored", [
    (["pos", "case"], "sum", [], "sums_features"), (["clitic"], "count", [("pos", "=", "noun")], "sums_features"),
    (["lemma"], "sum", [("lemmafreq", ">", 3), "not compound"], "sums_lemmas"), (["posx"], "count", [], "sums_"),
    (["lemma", "number"], "count", [("clitic", "in", "kin"), ("rellemmafreq", ">", 5)], "sums_both"),
    (["form"], "sum", [], None), (["pos"], "sum", [("pos", "in", "aux,verb")], None), (["pos"], "sum", [("len", ">", 3)], None)])
def test_stored_sums(pair, keys, operator, conditions, stored):
    plain, with_indexes = pair
    got = search.aggregate(with_indexes, keys, operator, conditions)
    assert got.collect() == search.aggregate(plain, keys, operator, conditions).collect()
    text = plan(got)
    assert f"indexes/{stored}" in text if stored else "indexes/sums" not in text
