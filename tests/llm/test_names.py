"""Columns of the given rows may have any name."""

from __future__ import annotations

import pickle

import pytest
from pyspark.sql import functions as F

from lexloom.llm import decontaminate, mixing, passages, quality, simhash

NAMES = ("_rest _whole _end _start _bucket _total _key _tokens _order _l0 _l1 _before _budget _given _room _w"
         " __node __id __none __content __first_id _c0 _c1 _c2 _quality score fp given root node count rows first"
         " first_id digest spans copy cut words chars item_id value seq start system w a.b").split()


def _mixed(docs, items, work):
    # a budget of all epochs, so every row comes that often
    return mixing.mix_sources(docs, {"lang": F.col("lang"), "first": F.col("first")}, (mixing.MAX_EPOCHS, 1), {},
                              work=work).drop("epoch", "tokens_taken").distinct()


OPERATORS = {
    "mix_sources": _mixed,
    "drop_contaminated": decontaminate.drop_contaminated,
    "drop_near_duplicates": lambda docs, items, work: simhash.drop_near_duplicates(docs, work),
    "drop_repeated_passages": lambda docs, items, work: passages.drop_repeated_passages(docs, work),
    "keep_good": lambda docs, items, work: quality.keep_good(docs, pickle.dumps(_all_good().p)),
}


def _all_good():
    network = quality.Network()
    network.fit([], [])
    return network


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_no_inner_name_clashes(spark, work, name):
    """Rows come back as given under all inner names of the operators."""
    texts = [" ".join(f"w{(i * 7 + j * (i + 3)) % 101}" for j in range(70 + i)) for i in range(6)]
    rows = [(i, t, "en", *(f"{n}-{i}" for n in NAMES)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(
        f"`{n}` string" for n in NAMES))
    items = spark.createDataFrame([(1, "what is the sum of 12 and 30 if both are added to 7 apples")],
                                  "item_id long, text string")
    got = OPERATORS[name](docs, items, work)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == rows
