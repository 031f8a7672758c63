from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from lexloom.functions import letterhash
from lexloom.functions.words import valid_word
from lexloom.operators import grams, lookup, neighbours, words
from lexloom.storage import keep, scratch, shared_folder

EXAMPLE = {"talo": 1, "valo": 5, "voi": 10, "koira": 3, "voida": 1, "voilla": 2, "oivoi": 1}


@pytest.fixture(scope="module")
def example(spark):
    return keep(spark.createDataFrame(list(EXAMPLE.items()), "form string, frequency long"))


def as_dict(df):
    return {row[0]: row[1] for row in df.collect()}


def test_trigrams(example):
    first, last = as_dict(grams.initial_gram_freqs(example)), as_dict(grams.final_gram_freqs(example))
    assert first["voi"] == 3 and last["alo"] == 6 and "voi" not in {k for k in last if last[k] == 10}


def test_bigrams(example):
    assert as_dict(grams.bigram_freqs(example))["oi"] == 18
    assert as_dict(grams.bigram_freqs(example, distinct=True))["oi"] == 17


def test_bigram_means(example):
    pairs = {}
    for word, freq in EXAMPLE.items():
        for i in range(len(word) - 1):
            pairs[word[i:i + 2]] = pairs.get(word[i:i + 2], 0) + freq
    means = as_dict(grams.bigram_means(example, grams.bigram_freqs(example)))
    assert means == {w: sum(pairs[w[i:i + 2]] for i in range(len(w) - 1)) // (len(w) - 1) for w in EXAMPLE}


def test_gram_contributions(example):
    rows = {r.form: r for r in grams.gram_contributions(example, ["oi", "al"]).collect()}
    assert (rows["oivoi"]["oi"], rows["talo"]["oi"], rows["valo"]["al"]) == (1, 0, 5)
    long = grams.gram_contribution_rows(example).groupBy("gram").agg(F.sum("frequency"))
    assert as_dict(long)["oi"] == 17


def test_nonword_bigrams(spark, example):
    items = spark.createDataFrame([("voizz", 1), ("alo", 2), ("voizz", 3), ("q", 4)],
                                  "item string, position int")
    freqs = grams.bigram_freqs(example)
    rows = {r.form: (r.order, r.bigramfreq) for r in grams.nonword_bigrams(items, freqs).collect()}
    vo, oi, al, lo = (as_dict(freqs)[g] for g in ("vo", "oi", "al", "lo"))
    assert rows == {"voizz": (3, (vo + oi) // 5), "alo": (2, (al + lo) // 3), "q": (4, 0)}
    by_pairs = grams.nonword_bigrams(items, freqs, denominator="pairs")
    assert {r.form: r.bigramfreq for r in by_pairs.collect()}["alo"] == (al + lo) // 2


def one_edit(a, b, swap):
    if len(a) == len(b):
        differ = [i for i in range(len(a)) if a[i] != b[i]]
        if len(differ) == 1:
            return True
        return (swap and len(differ) == 2 and differ[1] == differ[0] + 1
                and a[differ[0]] == b[differ[1]] and a[differ[1]] == b[differ[0]])
    short, long = sorted((a, b), key=len)
    i = next((i for i in range(len(short)) if short[i] != long[i]), len(short))
    return len(long) - len(short) == 1 and short[i:] == long[i + 1:]


@pytest.fixture(scope="module")
def random_forms(spark):
    random.seed(5)
    forms = sorted({"".join(random.choice("abä") for _ in range(random.randint(2, 6))) for _ in range(150)})
    rows = [(form, random.choice([1, 3, 50])) for form in forms]
    listed = [form for form in forms if random.random() < 0.5]
    frame = keep(spark.createDataFrame(rows, "form string, frequency long"))
    known = spark.createDataFrame([(f,) for f in listed], "form string")
    accepted = {f for f, n in rows if n >= 20 or (n >= 2 and f in set(listed))}
    return frame, known, dict(rows), accepted


@pytest.mark.parametrize("broadcast,swap,long_word", [
    (True, True, 64), (True, False, 64), (False, True, 64), (False, False, 4), (True, True, 4), (True, False, 1)])
def test_neighbours(random_forms, monkeypatch, broadcast, swap, long_word):
    monkeypatch.setattr(neighbours, "fits_broadcast", lambda table: broadcast)
    monkeypatch.setattr(neighbours, "LONG_WORD", long_word)  # all or some forms meet on hashes
    frame, known, freqs, accepted = random_forms
    flagged = keep(neighbours.flag_accepted(frame, known, 20, 2))
    assert {r.form for r in flagged.where("accepted").collect()} == accepted
    pairs = {(f, g) for f in freqs for g in accepted if f != g and one_edit(f, g, swap)}
    found = neighbours.edit1_neighbours(flagged, swap).collect()
    assert len(found) == len(pairs)
    assert {(r.form, r.neighbour) for r in found} == pairs
    assert all(r.frequency == freqs[r.neighbour] for r in found)
    assert as_dict(neighbours.edit1_counts(flagged, swap)) == {
        f: sum(1 for a, _ in pairs if a == f) for f in freqs}
    assert as_dict(neighbours.hamming_hood(flagged, swap)) == {
        f: sum(1 for a, b in pairs if a == f and len(a) == len(b)) for f in freqs}


def test_neighbours_of_very_long_forms(spark):
    stem = "ab" * 1500
    forms = [stem, stem[:70] + "x" + stem[71:], stem[:-1], stem + "q", "ba" + stem[2:], stem[:2000],
             "a" * 63, "a" * 64, "a" * 65, "a" * 64 + "b"]
    flagged = keep(spark.createDataFrame([(f, 1, True) for f in forms],
                                         "form string, frequency long, accepted boolean"))
    pairs = {(f, g) for f in forms for g in forms if f != g and one_edit(f, g, True)}
    assert len(pairs) > 8
    found = neighbours.edit1_neighbours(flagged, True).collect()
    assert len(found) == len(pairs) and {(r.form, r.neighbour) for r in found} == pairs
    assert as_dict(neighbours.edit1_counts(flagged, True)) == {
        f: sum(1 for a, _ in pairs if a == f) for f in forms}


def test_colliding_hashes_are_told_apart(random_forms, monkeypatch):
    frame, known, freqs, accepted = random_forms
    monkeypatch.setattr(neighbours, "LONG_WORD", 1)
    real = letterhash.substitution_keys
    monkeypatch.setattr(letterhash, "substitution_keys", lambda codes: (real(codes)[0], real(codes)[1] % 3))
    flagged = keep(neighbours.flag_accepted(frame, known, 20, 2))
    assert as_dict(neighbours.hamming_hood(flagged)) == {
        f: sum(len(f) == len(g) and one_edit(f, g, False) for g in accepted) for f in freqs}


def test_letter_hashes():
    rng = random.Random(8)
    key = lambda w: int(letterhash.whole_key(letterhash.letters(w))[0])
    for _ in range(200):
        w = "".join(rng.choice("abä\U0001f600") for _ in range(rng.randint(1, 12)))
        codes = letterhash.letters(w)
        places, keys = letterhash.deletion_keys(codes)
        assert [key(w[:i - 1] + w[i:]) for i in places] == keys.tolist()
        assert len(keys) == len({w[:i] + w[i + 1:] for i in range(len(w))} - {""})
        places, keys = letterhash.swap_keys(codes)
        swapped = [w[:i - 1] + w[i] + w[i - 1] + w[i + 1:] for i in places]
        assert [key(v) for v in swapped] == keys.tolist() and len(set(swapped)) == len(swapped)
        for i, k in zip(*letterhash.substitution_keys(codes)):
            assert letterhash.substitution_keys(letterhash.letters(w[:i - 1] + "z" + w[i:]))[1][i - 1] == k


def test_hundred_thousand_letters_with_partners(spark):
    """Key rows are of fixed size, one for each letter and kind; only true pairs bring letters together."""
    rng = random.Random(6)
    stem = "".join(rng.choice("abcdeä") for _ in range(100_000))
    forms = [stem, stem[:50_000] + "x" + stem[50_001:], stem[:77_777] + stem[77_778:], stem[:3] + "q" + stem[3:],
             stem[:-2] + stem[-1] + stem[-2], "talo", "tali"]
    flagged = keep(spark.createDataFrame([(f, 1, True) for f in forms],
                                         "form string, frequency long, accepted boolean"))
    start = time.time()
    keys = neighbours._hash_keys(flagged, letterhash.substitution_keys)
    assert keys.count() == sum(map(len, forms)) and keys.columns == ["id", "size", "place", "key"]
    pairs = {(f, g) for f in forms for g in forms if f != g and abs(len(f) - len(g)) < 2 and one_edit(f, g, True)}
    found = neighbours.edit1_neighbours(flagged, True).collect()
    assert len(found) == len(pairs) and {(r.form, r.neighbour) for r in found} == pairs
    assert as_dict(neighbours.hamming_hood(flagged)) == {f: sum(
        len(f) == len(g) and one_edit(f, g, False) for g in forms if g != f) for f in forms}
    assert time.time() - start < 120  # keys of 100,000 letters each would be 10^10


def test_junk_of_a_million_letters(spark):
    """It has no accepted form near its length, so it makes no keys."""
    forms = [("a" * 1_000_000, False), ("talo", True), ("tali", True), ("tal", False), ("talon", False)]
    flagged = keep(spark.createDataFrame([(f, 1, a) for f, a in forms],
                                         "form string, frequency long, accepted boolean"))
    junk = forms[0][0]
    assert as_dict(neighbours.hamming_hood(flagged, True)) == {
        junk: 0, "talo": 1, "tali": 1, "tal": 0, "talon": 0}
    assert as_dict(neighbours.edit1_counts(flagged, True)) == {
        junk: 0, "talo": 1, "tali": 1, "tal": 2, "talon": 1}
    assert {(r.form, r.neighbour) for r in neighbours.edit1_neighbours(flagged).collect()} == {
        ("talo", "tali"), ("tali", "talo"), ("tal", "talo"), ("tal", "tali"), ("talon", "talo")}


def test_scratch_is_removed(spark, tmp_path):
    import os

    with scratch(spark) as folder:
        kept = keep(spark.range(3).toDF("id"))
        assert kept.count() == 3
        local = folder.removeprefix("file:").replace("//", "/")
        assert os.path.isdir(local) and len(os.listdir(local)) == 1
    assert not os.path.exists(local)
    assert not keep(spark.range(1).toDF("id")).inputFiles()[0].startswith(folder)


def test_broadcast_check(spark):
    table = keep(spark.range(50).select("id", F.repeat(F.lit("x"), F.lit(1000)).alias("text")))
    assert lookup.fits_broadcast(table)
    assert not lookup.fits_broadcast(table, max_rows=49)
    assert not lookup.fits_broadcast(table, max_bytes=49_999)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_paths_agree(spark, how):
    rows = spark.range(2000).select((F.col("id") % 7 * (F.col("id") % 3)).alias("k"), F.col("id").alias("v"))
    table = keep(spark.createDataFrame([(0, "a"), (1, "b"), (4, "c")], "k long, name string"))
    small = lookup.lookup_join(rows, table, ["k"], how)
    salted = lookup.lookup_join(rows, table, ["k"], how, max_rows=0)
    assert sorted(small.select("k", "v", "name").collect(), key=str) == sorted(
        salted.select("k", "v", "name").collect(), key=str)


def test_number_sorted(spark):
    df = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("a"), (F.col("id") % 3).alias("b"))
    rows = lookup.number_sorted(df, ["a", "b"], "n").orderBy("n").collect()
    assert [r.n for r in rows] == list(range(1, 5001))
    assert [(r.a, r.b) for r in rows] == sorted((r.a, r.b) for r in rows)


@pytest.mark.parametrize("word,valid", [
    ("ab", True), ("a", False), ("a1", True), ("12", False), ("-ab", False), ("ab-", True), ("ab.", True),
    ("a'b", True), ("a#b", True), ("ab#", False), ("ab_", False), ("äö", True), ("a b", False), ("ab:", False),
    ("1a", True), ("ab\r", False), ("a%b", False), ("", False), ("ňa", False)])
def test_valid_word(spark, word, valid):
    assert spark.range(1).select(valid_word(F.lit(word)).alias("v")).first().v is valid


def test_prune_and_merge(spark):
    rows = spark.createDataFrame([
        ("olla", "on", "AUX", "_", 5), ("olla", "on", "VERB", "_", 2), ("talo", "talon", "NOUN", "Case=Gen", 1)],
        "lemma string, form string, pos string, feats string, frequency long")
    base = words.sum_words(rows)
    with pytest.raises(ValueError):
        words.prune_words(base)
    pruned = words.prune_words(base, drop_pos=["AUX"]).collect()
    assert {(r.form, r.pos, r.frequencyx, r.primary) for r in pruned} == {
        ("on", "VERB", 2, True), ("talon", "NOUN", 1, True)}
    merged = {(r.form, r.pos): (r.frequency, r.frequencyx) for r in words.merge_words(base, base).collect()}
    assert merged == {("on", "AUX"): (10, 14), ("on", "VERB"): (4, 14), ("talon", "NOUN"): (2, 2)}
    report = {r.criterion: (r.total, r.deleted, r.remaining)
              for r in words.prune_report(base, 2, ["AUX"], 4).collect()}
    assert report == {"pos": (3, 1, 2), "frequency": (3, 1, 2), "length": (3, 1, 2)}


def test_shared_folder_is_stable(spark):
    assert shared_folder(spark) == shared_folder(spark)


def test_large_lookup_is_merged_once(spark, monkeypatch):
    """A table counted too large is neither copied nor broadcast, however small its files are."""
    monkeypatch.setattr(lookup, "fits_broadcast", lambda *_: False)
    table = keep(spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("name")))
    joined = lookup.lookup_join(spark.range(5000).select((F.col("id") % 1500).alias("k")), table, ["k"], "inner")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "Generate" not in plan
    assert joined.count() == 3500
