from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from lexloom.llm import codes

VECTORS = "vec_id long, embedding array<double>, label int, code string, _0 int, id string"


def plain(rows, parts=8, entries=16, rounds=6):
    """Codes, errors and codebooks by comparing every part with every entry."""
    kept = [(i, [math.floor(4096 * x) for x in v]) for i, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v in kept) // parts)
    kept = [(i, v + [0] * (parts * width - len(v))) for i, v in kept]
    cut = lambda v, p: v[p * width:(p + 1) * width]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v in order] for p in range(parts)]

    def nearest(v, p):
        d = [sum((a - b) ** 2 for a, b in zip(cut(v, p), e)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        new = []
        for p in range(parts):
            held = [[] for _ in books[p]]
            for _, v in kept:
                held[nearest(v, p)[0]].append(cut(v, p))
            new.append([[sum(c) // len(h) for c in zip(*h)] if h else books[p][k] for k, h in enumerate(held)])
        books = new
    out = []
    for i, v in kept:
        found = [nearest(v, p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for k, _ in found), min(sum(d for _, d in found), 2 ** 63 - 1)))
    return out, books


def found(spark, work, rows, **options):
    df = spark.createDataFrame([(i, v, 1, "x", 2, "y") for i, v in rows], VECTORS).repartition(3)
    result, books = codes.vector_codes(df, work=work, **options)
    return [tuple(r) for r in result.collect()], books


def same(a, b):
    assert sorted(a, key=str) == sorted(b, key=str)


@pytest.mark.parametrize("block", [7, 2048])
def test_against_plain(spark, work, monkeypatch, block):
    monkeypatch.setattr(codes, "BLOCK", block)
    rng = random.Random(block)
    centres = [[rng.uniform(-1, 1) for _ in range(16)] for _ in range(30)]
    rows = [(i, [x + rng.gauss(0, 0.02) for x in rng.choice(centres)]) for i in range(400)]
    rows += [(500 + i, [0.5] * 16) for i in range(30)] + [(3, [0.25] * 16), (3, [0.25] * 16)]
    rows += [(600, None), (601, [0.1, None]), (602, [math.nan] * 16), (603, [math.inf] * 16), (None, [1.0] * 16),
             (604, [0.25] * 3), (605, []), (606, [1e308 * 1.7] * 16)]
    got, books = found(spark, work, rows)
    want, want_books = plain([r for r in rows if r[0] != 606])
    same(got, want)
    assert books == want_books
    said = ",".join(str(x) for book in want_books for e in book for x in e)
    assert codes.codebooks_sha256(books) == hashlib.sha256(said.encode()).hexdigest()


def test_ties_go_to_the_lower_index(spark, work):
    """Whole numbers on a small grid: very many equal distances."""
    rng = random.Random(2)
    rows = [(i, [rng.randint(-2, 2) / 4096 for _ in range(8)]) for i in range(300)]
    got, books = found(spark, work, rows, parts=2, entries=10)
    want, want_books = plain(rows, 2, 10)
    same(got, want)
    assert books == want_books


def test_dimension_that_parts_do_not_divide(spark, work):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(11)]) for i in range(60)]
    same(found(spark, work, rows, parts=4, entries=5, rounds=3)[0], plain(rows, 4, 5, 3)[0])


@pytest.mark.parametrize("size", [1e12, 1e30])
def test_beyond_exact_floating_point(spark, work, size):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-size, size) for _ in range(4)]) for i in range(40)] + [(90, [1.0, 2.0])]
    got, books = found(spark, work, rows, parts=2, entries=6)
    want, want_books = plain(rows, 2, 6)
    same(got, want)
    assert books == want_books


def test_few_and_none(spark, work):
    assert found(spark, work, [(5, [1.0, 2.0])], parts=2)[0] == [(5, "0000", 0)]
    assert found(spark, work, [(5, None)])[0] == []
    df = spark.createDataFrame([], VECTORS)
    assert codes.vector_codes(df, ["label"], work=work)[0].columns == ["vec_id", "label", "code", "error"]
    with pytest.raises(ValueError):
        codes.vector_codes(df, ["code"], work=work)


def test_bounds_hold_and_save_distances():
    """Over drifting entries, codes are those of all distances, with few of them measured."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (16, 8)).astype(float)
    x = centres[rng.integers(0, 16, 2000)] + rng.integers(-300, 300, (2000, 8))
    known, entries, moves = codes.Bounds.unknown(len(x), 4), centres.copy(), np.zeros(16)
    measured, widths = [], []
    for _ in range(8):
        measured.append(known.assign(x, entries, moves))
        widths.append(known.near.shape[1])
        d = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (known.code == d.argmin(axis=1)).all()
        roots = np.sqrt(d)
        rows = np.arange(len(x))
        assert (known.upper >= roots[rows, known.code]).all()
        assert (known.lower <= roots[rows[:, None], known.near]).all()
        rest = np.ones_like(roots, bool)
        rest[rows, known.code] = False
        rest[rows[:, None], known.near] = False
        assert (known.outer[:, None] <= np.where(rest, roots, np.inf)).all()
        following = entries + rng.integers(-20, 20, entries.shape)
        moves, entries = np.sqrt(((following - entries) ** 2).sum(axis=1)) * (1 + 1e-12), following
    assert measured[0] >= len(x) * 16 and max(measured[1:]) < len(x) * 16 / 4
    assert widths == sorted(widths, reverse=True) and widths[-1] == 2


def test_sums_by_label(spark, work):
    rows = spark.createDataFrame([(1, 5, 10), (2, 5, 20), (3, None, 2 ** 62), (4, None, 2 ** 62), (5, None, 2 ** 62)],
                                 "vec_id long, label int, error long")
    got = {r.vec_id: r.label_error for r in
           codes.with_group_sums(rows, "label", "error", "label_error", work).collect()}
    assert got == {1: 30, 2: 30, 3: 2 ** 63 - 1, 4: 2 ** 63 - 1, 5: 2 ** 63 - 1}
