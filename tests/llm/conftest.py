from __future__ import annotations

import pytest

from lexloom.llm.store import Workspace

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def work(spark, tmp_path):
    return Workspace(spark, "test", f"file://{tmp_path}")


@pytest.fixture
def docs(spark):
    """Makes a documents table of (doc_id, text) rows, with columns that clash with inner names."""

    def make(rows, **more):
        columns = {"lang": "en", "source": "s", "n_chars": 1, "fp": 3, "digest": b"x", "root": None,
                   "n": 7, "a": 1, "score": 0.5, "words": "w", "tokens": None} | more
        kinds = {"lang": "string", "source": "string", "n_chars": "long", "fp": "long",
                 "digest": "binary", "root": "long", "n": "int", "a": "int", "score": "double",
                 "words": "string", "tokens": "long"}
        schema = "doc_id long, text string, " + ", ".join(
            f"{k} {kinds.get(k, 'string')}" for k in columns)
        return spark.createDataFrame([(*row, *columns.values()) for row in rows], schema)

    return make


def edge_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long_text = " ".join(f"word{i % 977} and{i}" for i in range(150_000))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "One TWO three"),
        (7, "one two  three"), (7, "one two  three"), (None, "one two three"), (None, None),
        (8, long_text), (9, long_text + " end"), (10, "naïve Éa, 東京  x<|endoftext|>y z."),
        (11, "a" * 300_000), (12, "\x1c \x85 it's we're  x y"), (13, "..,a .,b ?!"),
    ]
