from __future__ import annotations

import os

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexloom.llm import tokencount
from lexloom.llm.store import table
from tests.llm.conftest import edge_rows

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows, path=BYTES):
    library = Tokenizer.from_file(path)
    found = []
    for doc, text in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        found.append((doc, len((text or "").encode()), n, n > 1024))
    return sorted(map(repr, found))


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_edges_and_second_run(spark, docs, work):
    rows = edge_rows() + [(20, "<|endoftext|>"), (21, "a <|endoftext|>b, <|endoftext|> \n c"),
                          (22, "don't. 'Tis 'll ... a.'s b,'re c\r\nd  e")]
    cache = work.path("cache")
    assert got(tokencount.count_tokens(docs(rows), BYTES, cache, work)) == expected(rows)
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t in rows})
    # The second run appends only the one new text.
    more = rows + [(30, "something new"), (31, "something new")]
    assert got(tokencount.count_tokens(docs(more), BYTES, cache, work)) == expected(more)
    assert spark.read.parquet(cache).count() == stored.count() + 1


def test_many_misses_are_shuffled(docs, work, monkeypatch):
    monkeypatch.setattr(tokencount, "BROADCAST_DIGESTS", 2)
    rows = edge_rows()
    assert got(tokencount.count_tokens(docs(rows), BYTES, work.path("cache"), work)) == expected(rows)


def test_empty_table(docs, work):
    assert got(tokencount.count_tokens(docs([]), BYTES, work.path("cache"), work)) == []


def test_versions_do_not_share_counts(docs, work):
    other = public_tokenizers.path("word_bpe_49k.json")
    cache, rows = work.path("cache"), [(1, "Some Words here"), (2, "x" * 50)]
    tokencount.count_tokens(docs(rows), BYTES, cache, work).collect()
    assert got(tokencount.count_tokens(docs(rows), other, cache, work)) == expected(rows, other)


def test_sentencepiece(docs, work):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    found = tokencount.count_tokens(docs([(1, "Some  words"), (2, None)]), path, work.path("c"), work)
    assert {r.doc_id: r.n_tokens for r in found.collect()} == {1: len(library.encode("Some  words")), 2: 0}


@pytest.mark.parametrize("known", [0, 3])
def test_memory_is_bounded(monkeypatch, known):
    monkeypatch.setattr(tokencount, "REMEMBERED", known)
    count = tokencount._Counter(BYTES)
    library = Tokenizer.from_file(BYTES)
    for text in ["a b c d, e", "f g\nh. i", "a  b", "x"]:
        assert count.count(text) == len(library.encode(text, add_special_tokens=False).ids)
        assert len(count.words) <= max(known, 8)


def test_registered(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    assert got(tokencount.op1_token_counts(spark, sf_dir)) == expected(docs)
    assert os.path.isfile(BYTES)
