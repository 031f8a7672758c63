from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lexloom.llm import periods
from tests.llm.conftest import edge_rows


def plain_runs(words, least=12):
    """Maximal stretches for every period; one also found with a shorter period is not of smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, 2 * q):
                found.setdefault((start, i + q - start), q)
    # A stretch with period q has smallest period q unless a shorter period holds all over it.
    rows = [(a, length, q) for (a, length), q in found.items()
            if not any(all(words[i] == words[i + p] for i in range(a, a + length - p)) for p in range(1, q))]
    return sorted(rows, key=lambda r: (r[0], r[2]))


def plain_words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def plain_kept(words, runs):
    return [w for i, w in enumerate(words) if not any(a + q <= i < a + length for a, length, q in runs)]


def random_words(rng):
    words = [rng.choice("abcd"[:rng.randint(1, 4)]) for _ in range(rng.randint(0, 45))]
    if words and rng.random() < 0.6:
        a, p = rng.randrange(len(words)), rng.randint(1, 8)
        words = words[:a] + [words[min(a + i % p, len(words) - 1)] for i in range(len(words) - a)]
    return words


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_against_plain(least):
    rng = random.Random(least)
    for _ in range(400):
        words = random_words(rng)
        want = plain_runs(words, least)
        symbols = ["abcd".index(w) + 1 for w in words]
        assert [tuple(r) for r in periods.runs_of(symbols, least).tolist()] == want, words
        runs = periods.word_runs([w.encode() for w in words], least)
        assert [tuple(r) for r in runs.tolist()] == want, words
        assert periods.collapsed(words, runs) == plain_kept(words, want)


def test_extensions_and_ranks():
    rng = random.Random(1)
    for _ in range(60):
        s = [rng.randint(1, 3) for _ in range(rng.randint(1, 60))]
        tree, n = periods.SuffixTree(s), len(s)
        order = sorted(range(n + 1), key=lambda i: s[i:])
        assert tree.ranks[order].tolist() == list(range(n + 1))
        pairs = [(a, b) for a in range(n + 1) for b in range(n + 1) if a != b]
        want = [next((k for k in range(n) if a + k >= n or b + k >= n or s[a + k] != s[b + k]), n) for a, b in pairs]
        a, b = np.array(pairs).T
        assert tree.extension(a, b).tolist() == want


def test_range_minima():
    rng = np.random.default_rng(2)
    for n in (1, 15, 16, 17, 100, 1000):
        values = rng.integers(0, 1000, n).astype(np.int32)
        a, b = np.sort(rng.integers(0, n, (2, 500)), axis=0)
        assert periods.RangeMin(values)(a, b).tolist() == [values[i:j + 1].min() for i, j in zip(a, b)]


def test_long_runs():
    n = 60_000
    assert periods.runs_of([1] * n).tolist() == [[0, n, 1]]
    assert periods.runs_of([1 + i % 777 for i in range(n)]).tolist() == [[0, n, 777]]
    fibonacci = "a", "ab"
    while len(fibonacci[1]) < 600:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    words = list(fibonacci[1])
    assert [tuple(r) for r in periods.word_runs([w.encode() for w in words]).tolist()] == plain_runs(words)


def test_stretches_cover_all_runs_and_little_else():
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(4000)]
    words[1000:1100] = [f"p{i % 9}" for i in range(100)]
    symbols = np.unique(words, return_inverse=True)[1]
    assert periods.repeated_stretches(symbols, 12) == [(1000, 1100)]


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in df.collect()), key=str)


def test_edges(spark, docs):
    rows = [(i, t if t is None or len(t) < 10_000 else t[:3000]) for i, t in edge_rows()]
    rows += [(20, "x y " * 20 + "é " * 13), (21, "a b c d e f " * 2), (21, "a b c d e f " * 2), (22, "a " * 11)]
    want = []
    for i, t in rows:
        words = plain_words(t)
        runs = plain_runs(words)
        want.append((i, len(words), runs, " ".join(plain_kept(words, runs))))
    assert rows_of(periods.find_runs(docs(rows).repartition(3))) == sorted(want, key=str)
    assert periods.find_runs(docs(rows).limit(0)).collect() == []
    with pytest.raises(ValueError):
        periods.find_runs(docs(rows), 1)


def test_very_long_text(spark, docs):
    rows = [r for r in edge_rows() if r[0] in (8, 9, 11)] + [(12, "la " * 200_000), (13, "one two three " * 100_000)]
    got = {r[0]: r[1:3] for r in rows_of(periods.find_runs(docs(rows)))}
    # word{i % 977} and{i}: no two neighbouring words come again
    assert got == {8: (300_000, []), 9: (300_001, []), 11: (1, []), 12: (200_000, [(0, 200_000, 1)]),
                   13: (300_000, [(0, 300_000, 3)])}


def test_query_against_plain(spark, sf_dir):
    got = sorted(tuple(r) for r in periods.op13_periods(spark, sf_dir).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect())
    want = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        words = plain_words(r.text)
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 2500 and h % 10:
            runs = [tuple(x) for x in periods.word_runs([w.encode() for w in words]).tolist()]  # too long for pairs
        else:
            runs = plain_runs(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
        want.append((r.doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                     digest("".join("%d,%d,%d\n" % x for x in runs)), digest(" ".join(plain_kept(words, runs)))))
    assert got == sorted(want) and sum(w[1] > 0 for w in want) > 5


def test_null_ids_are_not_made_periodic():
    words = [b"%d" % i for i in range(40)]
    assert periods.made_periodic(None, words) == words and periods.made_periodic(1, []) == []
