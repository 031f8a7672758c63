"""With nothing broadcast, as on very large tables, results stay the same."""

from __future__ import annotations

import pytest

from checks import fixture
from checks.compare import compare, connect
from checks.oracles import oracle_sql
from checks.queries import queries
from lexloom.operators import lookup, neighbours
from lexloom.plans.build import build_lexicon
from lexloom.storage import new_folder


@pytest.fixture
def nothing_fits(spark, monkeypatch):
    monkeypatch.setattr(lookup, "fits_broadcast", lambda *_: False)
    monkeypatch.setattr(neighbours, "fits_broadcast", lambda *_: False)
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


def test_build(spark, sf_dir, lexicon, nothing_fits):
    other = build_lexicon(fixture.stored_words(spark, sf_dir), new_folder(spark, "lexicon"),
                          accepted_forms=fixture.even_forms(spark, sf_dir),
                          auto=fixture.AUTO, minimum=fixture.MINIMUM)
    assert other.totals == lexicon.totals
    for name, table in lexicon.tables.items():
        assert other[name].columns == table.columns
        assert other[name].count() == table.count()
        assert other[name].exceptAll(table).isEmpty(), name


@pytest.mark.parametrize("name", ["conllu_tokens", "vrt_tokens", "wordlist_scan", "feature_ids",
                                  "word_bigram_freqs", "nonword_bigrams", "edit1_neighbours",
                                  "wordlist_lemmas"])
def test_query(spark, sf_dir, nothing_fits, name):
    good, note = compare(spark, connect(sf_dir), name, sf_dir, queries()[name], oracle_sql()[name])
    assert good, note
