from __future__ import annotations

import hashlib
from fractions import Fraction

from pyspark.sql import functions as F

from lexloom.llm import mixing
from tests.llm.conftest import edge_rows


def levels():
    return {name: F.col(name) for name in ("domain", "lang", "source")}



def plain_shares(budget, children):
    """Exact water filling: {name: (room, weight)} to {name: share}, before rounding."""
    open_, given, left = dict(children), {}, Fraction(budget)
    while open_:
        total = sum(w for _, w in open_.values())
        full = [n for n, (room, w) in open_.items() if room * total <= left * w]
        if not full:
            return given | {n: left * w / total for n, (_, w) in open_.items()}
        for n in full:
            given[n] = Fraction(open_[n][0])
        left -= sum(open_.pop(n)[0] for n in full)
    return given


def test_shortage_goes_to_siblings_before_ancestors(spark, work):
    rows = [("web", "en", "a", 100), ("web", "en", "b", 1000), ("web", "de", "c", 50),
            ("books", "en", "d", 2000), ("books", "fr", "e", 10), ("none", "en", "f", 500)]
    leaves = spark.createDataFrame(rows, "_l0 string, _l1 string, _l2 string, _total long")
    weights = {("web",): 2, ("none",): 0, ("web", "en"): 3, ("web", "en", "a"): 4}
    for budget in (0, 7, 300, 1500, 2999, 10_000_000):
        got = {(r._l0, r._l1, r._l2): int(r._given) for r in mixing.leaf_budgets(
            leaves, ["_l0", "_l1", "_l2"], budget, weights, 2).collect()}
        room = {r[:3]: 2 * r[3] for r in rows if r[0] != "none"}
        top = plain_shares(min(budget, sum(room.values())), {
            "web": (2300, 2), "books": (4020, 1)})
        mid = {("web", k): v for k, v in plain_shares(top["web"], {"en": (2200, 3), "de": (100, 1)}).items()}
        mid |= {("books", k): v for k, v in plain_shares(top["books"], {
            "en": (4000, 1), "fr": (20, 1)}).items()}
        low = {("web", "en", k): v for k, v in plain_shares(mid["web", "en"], {
            "a": (200, 4), "b": (2000, 1)}).items()}
        low |= {(*k, s): mid[k] for k, s in ((("web", "de"), "c"), (("books", "en"), "d"), (("books", "fr"), "e"))}
        assert sum(got.values()) == min(budget, 6320)
        assert all(abs(got[k] - low[k]) < 4 and got[k] <= room[k] for k in low) and len(got) == len(low)


def test_whole_epochs_then_a_seeded_prefix(docs, work):
    rows = [(i, " ".join(["w"] * (i % 7))) for i in range(200)] + [(5, "w w"), (5, "w w"), (None, "w")]
    given = docs(rows, domain="d")
    total = sum(len(t.split()) for _, t in rows)
    budget = total * 2 + total // 3
    got = mixing.mix_sources(given, levels(), budget, {}, work=work).collect()
    assert sum(r.tokens_taken for r in got) == budget
    for epoch in (0, 1):
        assert sorted(repr(r.doc_id) for r in got if r.epoch == epoch) == sorted(repr(d) for d, _ in rows)
    order = sorted((hashlib.md5(f"17|2|{'' if d is None else d}|{hashlib.md5(t.encode()).hexdigest()}".encode())
                    .hexdigest(), repr(d), len(t.split())) for d, t in rows if t)
    expected, left = [], total // 3
    for _, d, n in order:
        if left > 0:
            expected.append((d, min(n, left)))
            left -= n
    assert sorted(expected) == sorted((repr(r.doc_id), r.tokens_taken) for r in got if r.epoch == 2)
    other = mixing.mix_sources(given, levels(), budget, {}, seed=18, work=work).collect()
    assert {r.doc_id for r in other if r.epoch == 2} != {r.doc_id for r in got if r.epoch == 2}


def test_edges(docs, work):
    rows = edge_rows()
    given = docs(rows, domain=None, epoch="e", tokens_taken="t", lang=None)
    got = mixing.mix_sources(given, levels(), (3, 4), {}, work=work)
    words = sum(len((t or "").encode().split()) for _, t in rows)
    assert got.agg(F.sum("tokens_taken")).first()[0] == words * 3 // 4
    assert set(got.columns) == set(given.columns)
    assert mixing.mix_sources(docs([], domain="d"), levels(), 10, {}, work=work).collect() == []
    for budget in (0, -5):
        assert mixing.mix_sources(given, levels(), budget, {}, work=work).collect() == []
    everything = mixing.mix_sources(given, levels(), 10 ** 12, {}, max_epochs=2, work=work)
    assert everything.count() == 2 * len(rows)
