from __future__ import annotations

import random

import pytest
import xxhash

from lexloom.llm import simhash
from tests.llm.conftest import edge_rows


def plain_fingerprint(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c == " " or "\t" <= c <= "\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    shingles = [words[i:i + 3] for i in range(len(words) - 2)] if len(words) > 2 else [words] * bool(words)
    hashes = [xxhash.xxh64(" ".join(s).encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints, distance=2):
    """Union-find over all pairs of distinct fingerprints; smallest id per group."""
    values = sorted({p for _, p in prints})
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= distance:
                parent[find(a)] = find(b)
    smallest = {}
    for doc, p in prints:
        if doc is not None:
            smallest[find(p)] = min(doc, smallest.get(find(p), doc))
    return {p: smallest.get(find(p)) for p in values}


def check(rows, got):
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    expected = plain_components(prints)
    assert sorted(map(repr, got)) == sorted(
        repr((d, f"{p:016x}", expected[p])) for d, p in prints)


def rows_of(df):
    return [(r.doc_id, r.fingerprint, r.component_id) for r in df.collect()]


def test_edges(docs, work):
    rows = [r for r in edge_rows() if len(r[1] or "") < 400_000]
    check(rows, rows_of(simhash.simhash_components(docs(rows), work)))


def test_empty_table(docs, work):
    assert rows_of(simhash.simhash_components(docs([]), work)) == []


@pytest.mark.parametrize("small_bucket", [None, 2, 64])
def test_links_join_all_close_fingerprints(spark, work, small_bucket):
    """Chains, dense groups around one centre and noise, all signs, against all pairs."""
    rng = random.Random(small_bucket or 1)
    values = [rng.getrandbits(64) for _ in range(60)]
    centre = rng.getrandbits(64)
    values += [centre ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(5))}) for _ in range(250)]
    for _ in range(30):
        values.append(values[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    values += [0, (1 << 64) - 1, 1 << 63, 3]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v, i) for i, v in enumerate(signed)], "fp long, doc long")
    links = [(r.a, r.b) for r in simhash.near_links(prints, work, small_bucket=small_bucket).collect()]
    full = (1 << 64) - 1
    assert all(((a & full) ^ (b & full)).bit_count() <= 2 for a, b in links)
    from lexloom.llm.components import components

    roots = {r.node & full: r.root for r in components(
        spark.createDataFrame(links, "a long, b long"), work).collect()}
    expected = plain_components([(i, v) for i, v in enumerate(values)])
    groups = {}
    for i, v in enumerate(values):
        groups.setdefault(roots.get(v, ("alone", v)), set()).add(expected[v])
    assert all(len(g) == 1 for g in groups.values())
    assert len(groups) == len(set(expected.values()))


def test_registered(spark, sf_dir):
    from lexloom.llm.store import table

    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    check(docs, rows_of(simhash.op10_simhash(spark, sf_dir)))
