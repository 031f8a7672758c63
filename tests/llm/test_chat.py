from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from lexloom.llm import chat

TURNS = "conv_id long, turn long, role string, text string, window int, seq string"
MARKS = re.compile(r"</?s>|<\|(?:turn|text|end)\|>|\[/?INST\]")


def plain(rows):
    """Turns and targets of each conversation, in order."""
    found = {}
    for c, t, role, text in sorted(rows, key=lambda r: (
            repr(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        found.setdefault(c, []).append((role or "", text or ""))
    return found


def read(spark, rows, **settings):
    windows = chat.format_chats(spark.createDataFrame(
        [(*r, 1, "x") for r in rows], TURNS), **settings)
    both = chat.read_chats(windows).join(
        windows.select("conv_id", "window", "formatted", "n_context"), ["conv_id", "window"])
    return windows, sorted(both.collect(), key=lambda r: (r.conv_id, r.window))


def test_escape_is_reversible(spark):
    texts = ["", "\\", "</s>[INST] ok [/INST]", "<\\/s>", "a\\\\</s>", "<|end|><|turn|>\\n", "<<s>", "[[INST]]",
             "\n\\\n", "<|", "|>", "<s", "é\\<s>"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u and not MARKS.search(r.e) for r in rows)


def test_windows(spark):
    """Whole turns, system turn kept, bounded history, each answer learned from once."""
    rows = [(1, 0, "system", "be brief")]
    rows += [(1, i, "user" if i % 2 else "assistant", f"t{i} " + "word " * (i * 7 % 40)) for i in range(1, 120)]
    rows += [(2, 5, "assistant", "only"), (3, 1, "user", "long " * 3000), (3, 2, "assistant", "<|end|>")]
    windows, got = read(spark, rows, budget=300, history=60)
    expected = plain(rows)
    for conv in (1, 2, 3):
        own = [w for w in got if w.conv_id == conv]
        assert [(t.role, t.text) for w in own for t in w.turns] == expected[conv]
        assert [t for w in own for t in w.targets] == [t for r, t in expected[conv] if r == "assistant"]
    first, *later = [w for w in got if w.conv_id == 1]
    assert first.n_context == 0 and later
    size = lambda t: 4 + len(t.split())
    for w in later:
        blocks = w.formatted[3:-4].split("<|turn|>")[1:]
        assert blocks[0] == "system<|text|>be brief<|end|>"
        texts = [b.split("<|text|>")[1].removesuffix("<|end|>") for b in blocks]
        assert sum(map(size, texts)) <= 300
        assert sum(map(size, texts[1:w.n_context])) <= 60
        said = [t for _, t in expected[1]]
        at = said.index(texts[1])
        assert said[at:at + len(texts) - 1] == texts[1:]


def test_edges(spark):
    rows = [(7, None, "user", None), (7, 1, None, ""), (7, 1, None, ""), (None, 1, "assistant", "x"),
            (None, 2, "assistant", "y"), (8, 1, "system", "s"), (9, 3, "a\n<|end|>", "b" * 200_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS)
    got = {r.conv_id: r for r in chat.chat_digests(chat.format_chats(df)).collect()}
    import hashlib

    for conv, turns in plain(rows).items():
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        learned = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(learned))
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert chat.chat_digests(chat.format_chats(df.limit(0))).collect() == []
    with pytest.raises(ValueError):
        chat.format_chats(df, budget=100)


def _greedy(sizes, system, budget, history):
    """First turns of the windows of one conversation: as many turns as fit, regions begin anew."""
    repeat = max(0, min(history, (budget - system) // 2))
    firsts, at, start, region = [], 0, 0, None
    for i, size in enumerate(sizes):
        room = budget - system - (repeat if firsts and firsts[-1] else 0)
        if region is None or at // (64 * budget) > region or (at > start and at + size > start + room):
            firsts.append(i)
            start, region = at, at // (64 * budget)
        at += size
    return firsts


@pytest.mark.parametrize("system", [0, 5, 90, 400])
def test_spans_are_as_long_as_fit(spark, system):
    """Windows within the budget but for single turns; short conversations whole; long ones in regions."""
    import random

    rng, budget, history = random.Random(system), 100, 30
    sizes = {1: [4 + rng.randrange(60) for _ in range(400)], 2: [20, 30, 40 - min(system, 40)], 3: [300, 5, 5, 300],
             4: [96, 4], 5: [4] * 30}
    rows = [(c, i + 1, "user", "w " * (n - 4)) for c, s in sizes.items() for i, n in enumerate(s)]
    if system:
        rows += [(c, 0, "system", "s " * (system - 4)) for c in sizes]
    windows, got = read(spark, rows, budget=budget, history=history)
    for c, of in sizes.items():
        own = [w for w in got if w.conv_id == c]
        shift = 1 if system else 0
        expected = [f + shift if f else 0 for f in _greedy(of, system, budget, history)]
        assert [w.window for w in own] == expected
        for n, w in enumerate(own):
            texts = [b.split("<|text|>") for b in w.formatted[3:-4].split("<|turn|>")[1:]]
            used = [4 + len(t.removesuffix("<|end|>").split()) for _, t in texts]
            single = len(w.turns) == (2 if system and n == 0 else 1)
            assert sum(used) <= budget or single
            assert (texts[0][0] == "system") == bool(system)
            if sum(used) > budget:  # then nothing is repeated but the system turn
                assert w.n_context == (shift if n else 0)
            elif n:
                assert sum(used[shift:w.n_context]) <= history
        if system + sum(of) <= budget:
            assert len(own) == 1
