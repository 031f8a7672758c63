from __future__ import annotations

import gzip
import random

import numpy as np
import pytest

from lexloom.functions.feats import core_feats
from lexloom.languages import features_for
from lexloom.operators.words import count_words, rejected_tokens
from lexloom.operators.lookup import numbered_lines
from lexloom.sources.conllu import read_conllu, read_conllu_tokens
from lexloom.sources.text import scan
from lexloom.sources.vrt import read_vrt, read_vrt_tokens
from lexloom.sources.wordlist import read_wordlist
from pyspark.sql import functions as F


def line(number, form, lemma, upos, feats="_"):
    return "\t".join([number, form, lemma, upos, "_", feats, "0", "_", "_", "_"])


SENTENCES = [
    ["# sent_id = 1", "# text = Autotallissakin ei",
     line("1", "Autotallissakin", "auto#talli", "NOUN", "Number=Sing|Case=Ine|Clitic=Han,Kin|Degree=Pos"),
     line("2-3", "eikä", "_", "_"),
     line("2", "ei", "ei", "AUX", "Polarity=Neg"),
     line("3", ".", ".", "PUNCT")],
    ["# sent_id = 2",
     line("1", "talonsa", "talo", "NOUN", "Number[psor]=Sing|Number=Sing|Case=Nom|Person[psor]=3"),
     line("2", "iso  talo", "iso  talo", "NOUN", "Case=Gen|Case=Nom"),
     line("3", "x%y", "x%y", "SYM"),
     line("4", "ei", "ei", "VERB")],
    [line("1", "ei", "ei", "AUX", "Polarity=Neg"), line("2", "a", "a", "NOUN")],
]
TEXT = "\n\n".join("\n".join(s) for s in SENTENCES) + "\n\n"


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    (folder / "sub").mkdir()
    (folder / "a.conllu").write_text("\n" + TEXT, encoding="utf8")
    with gzip.open(folder / "sub" / "b.conllu.gz", "wt", encoding="utf8") as handle:
        handle.write(TEXT)
    (folder / "crlf.conllu").write_bytes(TEXT.replace("\n", "\r\n").encode())
    (folder / "notes.md").write_text("1\tnot\tread\tNOUN\n")
    return folder


def test_conllu_tokens(spark, corpus):
    rows = read_conllu(spark, str(corpus / "a.conllu")).orderBy("sent_id", "token_id").collect()
    assert [(r.sent_id, r.token_id, r.form) for r in rows] == [
        (1, "1", "Autotallissakin"), (1, "2", "ei"), (1, "3", "."),
        (2, "1", "talonsa"), (2, "2", "iso talo"), (2, "3", "x%y"), (2, "4", "ei"),
        (3, "1", "ei"), (3, "2", "a")]
    assert rows[0].feats == "Number=Sing|Case=Ine|Clitic=Han,Kin|Degree=Pos"


@pytest.mark.parametrize("name", ["sub/b.conllu.gz", "crlf.conllu"])
def test_conllu_gzip_and_line_ends(spark, corpus, name):
    plain = read_conllu(spark, str(corpus / "a.conllu")).drop("file")
    other = read_conllu(spark, str(corpus / name)).drop("file")
    assert sorted(plain.collect()) == sorted(other.collect())
    counted = read_conllu_tokens(spark, str(corpus / name))
    assert sorted(plain.drop("sent_id").collect()) == sorted(counted.collect())


def test_conllu_tree_and_caps(spark, corpus):
    tree = read_conllu_tokens(spark, str(corpus), with_file=True)
    assert tree.select("file").distinct().count() == 3
    assert tree.count() == 27
    first = read_conllu_tokens(spark, str(corpus), file_cap=1, with_file=True)
    assert first.select("file").distinct().count() == 1
    capped = read_conllu(spark, str(corpus), sentence_cap=1)
    per_file = {r.file.rsplit("/", 1)[1]: r["count"] for r in capped.groupBy("file").count().collect()}
    assert per_file["a.conllu"] == per_file["b.conllu.gz"] == 3
    assert {r.sent_id for r in capped.select("sent_id").distinct().collect()} == {1}


def test_sentence_numbers_over_splits(spark, tmp_path):
    path = tmp_path / "long.conllu"
    path.write_text("".join(f"# n\n{line('1', f'word{i}', 'word', 'NOUN')}\n\n" for i in range(1, 2001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        tokens = read_conllu(spark, str(path))
        assert tokens.rdd.getNumPartitions() > 4
        assert tokens.where(F.col("form") != F.concat(F.lit("word"), "sent_id")).count() == 0
        assert tokens.count() == 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_counting(spark, corpus):
    tokens = read_conllu_tokens(spark, str(corpus / "a.conllu"))
    rows = {(r.lemma, r.form, r.pos): r for r in count_words(tokens, features_for("fi")).collect()}
    assert set(rows) == {("auto#talli", "autotallissakin", "NOUN"), ("ei", "ei", "AUX"),
                         ("ei", "ei", "VERB"), ("talo", "talonsa", "NOUN")}
    assert rows["auto#talli", "autotallissakin", "NOUN"].feats == "Case=Ine|Clitic=Han,Kin|Number=Sing"
    aux, verb = rows["ei", "ei", "AUX"], rows["ei", "ei", "VERB"]
    assert (aux.frequency, verb.frequency, aux.frequencyx, verb.frequencyx) == (2, 1, 3, 3)
    assert (aux.primary, verb.primary, aux.posx, aux.feats) == (False, True, "VERB", "_")
    kept = count_words(tokens, features_for("fi"), origcase=True)
    assert kept.where(F.col("form") == "Autotallissakin").count() == 1


def test_rejects(spark, corpus):
    tokens = read_conllu(spark, str(corpus / "a.conllu"))
    rows = rejected_tokens(tokens).orderBy("form").collect()
    assert [(r.sent_id, r.form, r.lemma) for r in rows] == [
        (2, "iso talo", "iso talo"), (2, "x%y", "x%y")]


@pytest.mark.parametrize("feats,expected", [
    ("_", "_"), (None, "_"), ("Degree=Pos", "_"), ("Case=Gen|Case=Nom", "Case=Nom"),
    ("Person=1|Case=Nom|Case=Gen|Person=2|Case=Ine", "Case=Ine|Person=2"),
    ("Number[psor]=Sing|Number=Plur|Foo=x", "Number=Plur|Number[psor]=Sing"),
])
def test_core_feats(spark, feats, expected):
    row = spark.range(1).select(core_feats(F.lit(feats).cast("string"), features_for("fi")).alias("f"))
    assert row.first().f == expected


@pytest.mark.parametrize("split_bytes", [97, 211, 4096])
def test_sentence_numbers_over_many_splits(spark, tmp_path, split_bytes):
    """Runs of one to three blank lines, both line ends, plain and gzip, in one tree."""
    rng = random.Random(split_bytes)
    expected = []
    for name in ("a.conllu", "b.conllu", "c.conllu.gz"):
        end = "\r\n" if name[0] == "b" else "\n"
        text = end * rng.randrange(3)
        for number in range(1, 120):
            text += f"# sent_id = {number}{end}" * rng.randrange(2)
            for token in range(1, rng.randrange(2, 5)):
                form = "w" * rng.randrange(1, 60)
                text += line(str(token), form, form, "NOUN") + end
                expected.append((name, number, str(token), form))
            text += end * rng.randrange(1, 4)
        data = text.encode()
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith("gz") else data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = read_conllu(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    found = [(r.file.rsplit("/", 1)[1], r.sent_id, r.token_id, r.form) for r in rows]
    assert sorted(found) == sorted(expected)


def test_numbering_does_not_move_text(spark, corpus):
    """The scan side of the second pass has no exchange, however small the bound on joins is."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = read_conllu(spark, str(corpus))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    with pytest.raises(ValueError, match="splits"):
        numbered_lines(scan(spark, str(corpus)), lambda lines: np.ones(len(lines)), every=True, most=1)


def test_numbering_returns_numbers_only(spark, corpus):
    """Lines do not come back from Python, and the path of a file does not go there with each of them."""
    plan = read_conllu(spark, str(corpus))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
    call = plan[plan.index("ArrowEvalPython"):].split("\n")[0]
    assert "_file#" in call and "file_path" not in call


HEADER = "<!-- #vrt positional-attributes: ref word lemma pos msd dephead deprel lex/ -->\n"


def test_vrt(spark, tmp_path):
    (tmp_path / "named.vrt").write_text(
        HEADER + '<text id="1">\n<sentence id="1">\n'
        "1\tTalon\ttalo\tNOUN\tCASE_Gen|NUM_Sg\t0\troot\t_\n"
        "2\ton\tolla\tVERB\tMOOD_Ind_x|PRS\t0\troot\t_\n</sentence>\n"
        '<sentence id="2">\n1\tja\tja\tCONJ\t_\t0\tcc\t_\n'
        "2\tsen\tse\tPRON\tCase=Gen|A_B\t0\tx\t_\n</sentence>\n</text>\n")
    (tmp_path / "unnamed.vrt").write_text(
        "<text>\n<sentence>\n"
        "Talon\t1\ttalo\t_\tNOUN\tCASE_Gen\t0\troot\t_\t_\t_\n</sentence>\n</text>\n")
    rows = read_vrt(spark, str(tmp_path)).collect()
    found = sorted((r.file.rsplit("/", 1)[1], r.sent_id, r.token_id, r.form, r.lemma, r.upos, r.feats)
                   for r in rows)
    assert found == [
        ("named.vrt", 1, "1", "Talon", "talo", "NOUN", "CASE=Gen|NUM=Sg"),
        ("named.vrt", 1, "2", "on", "olla", "VERB", "MOOD=Ind_x|PRS"),
        ("named.vrt", 2, "1", "ja", "ja", "CONJ", "_"),
        ("named.vrt", 2, "2", "sen", "se", "PRON", "Case=Gen|A_B"),
        ("unnamed.vrt", 1, "1", "Talon", "talo", "NOUN", "CASE_Gen")]
    counted = sorted((r.token_id, r.form, r.lemma, r.upos, r.feats) for r in read_vrt_tokens(
        spark, str(tmp_path)).collect())
    assert counted == sorted(row[2:] for row in found)
    given = read_vrt(spark, str(tmp_path / "named.vrt"), attributes=["ref", "lemma", "word", "pos", "msd"])
    assert {r.lemma for r in given.collect()} == {"Talon", "on", "ja", "sen"}


@pytest.mark.parametrize("content,expected", [
    ("# type=form\n# only forms\nkuusi\nauto\nnäätä\n".encode(),
     [("form", "kuusi", 1), ("form", "auto", 2), ("form", "näätä", 3)]),
    ("before\n# type =nonword\n\n auti \nsautk\n".encode(), [("nonword", "auti", 1), ("nonword", "sautk", 2)]),
    ("﻿# type = form\nnäätä\nhattu\n".encode(), [("form", "näätä", 1), ("form", "hattu", 2)]),
    ("# type = lemma\nnäätä\nvoi\n".encode("latin-1"), [("lemma", "näätä", 1), ("lemma", "voi", 2)]),
    (b"# type=invalid\nfoo\nbar\n", []),
    (b"# type=invalid\nfoo\n# type = form\nbar\n# type = lemma\nbaz\nbar\n",
     [("form", "bar", 1), ("form", "baz", 2), ("form", "bar", 3)]),
])
def test_wordlist(spark, tmp_path, content, expected):
    path = tmp_path / "list.txt"
    path.write_bytes(content)
    rows = read_wordlist(spark, str(path)).orderBy("position").collect()
    assert [(r.type, r["item"], r.position) for r in rows] == expected
