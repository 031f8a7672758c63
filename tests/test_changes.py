"""Merging and pruning by what changes, against building everything anew."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import words
from lexloom.plans import build, changes
from lexloom.sources.store import TABLES, Lexicon
from lexloom.storage import keep, new_folder
from tests.test_plans import plan

FEATS = ["_", "Case=Gen|Number=Sing", "Case=Ine|Clitic=Han,Kin", "Clitic=Kin|Derivation=Inen,Vs", "Mood=Ind"]
ROW = "lemma string, form string, pos string, feats string, frequency long"


def word_rows(spark, rng, n, long_forms=()):
    rows = {}
    for _ in range(n):
        form = "".join(rng.choice("abä") for _ in range(rng.randint(2, 5)))
        form = rng.choice([form, form, form, *long_forms])
        lemma = rng.choice([form, form[:-1] + "a", form[:2] + "#" + form[2:] if len(form) > 3 else form])
        key = (lemma, form, rng.choice(["NOUN", "VERB", "AUX", "ADJ"]), rng.choice(FEATS))
        rows[key] = rows.get(key, 0) + rng.choice([1, 1, 2, 9])
    return keep(words.sum_words(spark.createDataFrame([(*k, v) for k, v in rows.items()], ROW)), "rows")


def contents(lexicon):
    """Rows of each table as sorted text; feature tables without their ids."""
    used = lexicon["wide"].select("feats", "pos").distinct()
    out = {}
    for name in TABLES:
        df = lexicon[name]
        if name == "features":
            df = df.drop("featid").join(used, ["feats", "pos"])
        elif name == "feature_values":
            df = df.join(lexicon["features"].select("featid", "feats", "pos").join(used, ["feats", "pos"]), "featid").drop("featid")
        doubles = [c for c, t in df.dtypes if t == "double"]
        df = df.withColumns({c: F.round(c, 9) for c in doubles})
        out[name] = sorted(map(str, df.select(sorted(df.columns)).collect()))
    return out


@pytest.mark.parametrize("seed,broadcast,pairs,swap", [
    (2, True, 1 << 16, True), (4, False, 3, False)])
def test_merge_and_prune(spark, monkeypatch, seed, broadcast, pairs, swap):
    rng = random.Random(seed)
    stem = "ab" * 40
    long_forms = [stem, stem[:-1] + "ä", "b" + stem[1:]] if seed < 3 else []
    base, more = word_rows(spark, rng, 150, long_forms), word_rows(spark, rng, 25, long_forms)
    known = keep(base.select("form").unionByName(more.select("form")).distinct().where("hash(form) % 2 = 0"), "known")
    options = {"accepted_forms": known, "auto": 12, "minimum": 3, "transpositions": swap}
    first = build.build_lexicon(base, new_folder(spark, "first"), **options)
    before = contents(first)
    monkeypatch.setattr(changes, "fits_broadcast", lambda table: broadcast)
    monkeypatch.setattr(changes, "PAIR_ARRAY", pairs)
    merged = changes.merge_into(first, more, **options)
    whole = build.build_lexicon(words.merge_words(base, more), new_folder(spark, "whole"), **options)
    got, want = contents(merged), contents(whole)
    for name in TABLES:
        assert got[name] == want[name], name
    old = {(r.feats, r.pos): r.featid for r in first["features"].collect()}
    new = {(r.feats, r.pos): r.featid for r in merged["features"].collect()}
    assert old.items() <= new.items() and len(set(new.values())) == len(new)
    assert contents(first) == before
    criteria = {"min_frequency": 2, "drop_pos": ["ADJ"], "max_length": 60}
    pruned = changes.prune_from(merged, **criteria, **options)
    whole = build.build_lexicon(words.prune_words(merged["lexicon"], **criteria), new_folder(spark, "pruned"), **options)
    got, want = contents(pruned), contents(whole)
    for name in TABLES:
        assert got[name] == want[name], name
    assert pruned.totals == whole.totals and len(got["forms"]) < len(contents(merged)["forms"])


def test_nothing_added(spark, lexicon):
    none = lexicon["lexicon"].limit(0)
    merged = changes.merge_into(lexicon, none)
    assert merged.totals == lexicon.totals
    assert merged["wide"].exceptAll(lexicon["wide"]).count() == 0
    with pytest.raises(ValueError):
        changes.merge_into(lexicon, none, lexicon.path)


def test_small_change_leaves_the_base_unshuffled(spark, lexicon):
    """The base's rows are filtered and completed by broadcasts only."""
    few = keep(lexicon["lexicon"].where("hash(form) % 100 = 0").select(*words.WORD_KEY, "frequency"), "few")
    new = words.sum_words(few)
    change = changes.Change(lexicon, new.select(changes.GROUP), words.merge_words(new, few))
    rows, in_order = change.wide(lexicon["features"])
    assert in_order
    for df in (rows, change.forms(), change.all_shares, change.word_means(change.forms())):
        text = plan(df)
        exchanges = [line for line in text.split("\n\n")[0].splitlines() if "Exchange" in line]
        assert exchanges and all("BroadcastExchange" in line for line in exchanges)
    # Rows that do not change keep their place in the order of frequencies.
    stored = keep(rows, "wide")
    parts = stored.select(F.input_file_name().alias("file"), "frequencyx").groupBy("file").agg(
        F.min("frequencyx").alias("low"), F.max("frequencyx").alias("high")).collect()
    assert len(parts) > 1


def test_interrupted_build_is_not_opened(spark, monkeypatch):
    rng = random.Random(9)
    rows = word_rows(spark, rng, 30)
    path = new_folder(spark, "half")
    with pytest.raises(ValueError, match="no finished lexicon"):
        Lexicon.load(spark, path)
    build.build_lexicon(rows, path)
    before = contents(Lexicon.load(spark, path))

    def fails(*_):
        raise RuntimeError("a step failed")

    with monkeypatch.context() as patched:
        patched.setattr(build, "corpus_totals", fails)
        with pytest.raises(RuntimeError):
            build.build_lexicon(word_rows(spark, rng, 20), path)
    with pytest.raises(ValueError, match="interrupted"):
        Lexicon.load(spark, path)
    build.build_lexicon(rows, path)
    assert contents(Lexicon.load(spark, path)) == before
