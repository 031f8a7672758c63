"""Quality and toxicity: held-out accuracy, whole texts, odd rows."""

from __future__ import annotations

import math
import pickle
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import quality, toxicity
from lexloom.llm.sample import labelled_sample
from lexloom.llm.store import table
from lexloom.llm.wordhash import words
from tests.llm.conftest import edge_rows


def sentence(rng, words):
    return " ".join(rng.choice(words) for _ in range(8)) + ". "


@pytest.fixture(scope="module")
def corpus():
    """Good prose; bad text with marks, in capitals or repeating words; insults in one sentence."""
    rng = random.Random(3)
    plain = ["".join(rng.choice("aeiou") + rng.choice("bdlmnrst") for _ in range(rng.randrange(1, 4)))
             for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        text = "".join(sentence(rng, plain) for _ in range(rng.randrange(3, 30)))
        bad, toxic = i % 4 == 0, i % 3 == 0
        if toxic:
            at = text.find(". ", len(text) // 2) + 2
            text = text[:at] + f"You {rng.choice(['vile', 'awful'])} {rng.choice(['gorx', 'gorxen'])}! " + text[at:]
        if bad:
            text = [text.replace(" ", "### "), text.upper().replace(" ", "!! "),
                    " ".join(w + (" " + w) * 6 for w in text.split())][i // 4 % 3]
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def frames(spark, docs, corpus, more=()):
    rows, labels = corpus
    return docs(rows + list(more)), spark.createDataFrame(
        labels + [(1, None, None), (None, 1, 1), (5000, 7, 7)], "doc_id long, quality int, toxic int")


def test_quality(spark, docs, corpus):
    got = {r.doc_id: r for r in quality.quality_scores(*frames(spark, docs, corpus)).collect()}
    truth = {d: q for d, q, _ in corpus[1]}
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d in truth)
    held = [d for d in truth if got[d].held_out]
    assert len(held) > 60 and sum(got[d].predicted == truth[d] for d in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_toxicity_names_the_sentence(spark, docs, corpus):
    got = {r.doc_id: r for r in toxicity.toxicity_scores(*frames(spark, docs, corpus)).collect()}
    truth, text = {d: t for d, _, t in corpus[1]}, dict(corpus[0])
    held = [d for d in truth if got[d].held_out]
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d in truth)
    assert sum(got[d].predicted == truth[d] for d in held) >= 0.95 * len(held)
    plain = [d for d in held if truth[d] and d % 4]
    named = [text[d][got[d].sentence_start:got[d].sentence_end] for d in plain]
    assert sum("gorx" in s and len(s) < 60 for s in named) >= 0.95 * len(named)


@pytest.mark.parametrize("score", [quality.quality_scores, toxicity.toxicity_scores])
def test_edges(spark, docs, score):
    edges = edge_rows()
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = score(docs(edges), labels).collect()
    assert len(got) == len(edges) and all(0 <= r.score <= 1 for r in got)
    assert {r.held_out is None for r in got if r.doc_id is None} == {True}
    assert score(docs([]), labels).collect() == []
    one = spark.createDataFrame([(i, 1, 0) for i in range(1, 14)], "doc_id long, quality int, toxic int")
    assert len({r.predicted for r in score(docs(edges), one).collect()}) == 1


def test_network_sees_whole_texts(monkeypatch):
    """Blocks and neighbours do not change a score; the last bytes count."""
    rng = random.Random(1)
    texts = ["".join(chr(rng.randrange(32, 300)) for _ in range(n)) for n in (0, 1, 3, 50, 5000, 300_000)]
    network = quality.Network(3)
    alone = np.array([network.score([t])[0] for t in texts])
    assert np.allclose(network.score(texts), alone, atol=1e-5)
    monkeypatch.setattr(quality, "_BLOCK", 512)
    assert np.allclose(network.score(texts), alone, atol=1e-5)
    long = texts[-1]
    assert network.score([long])[0] != network.score([long + "#" * 3000])[0]


def test_gradient():
    """Of the loss of one text, by each group of parameters, against small differences."""
    network = quality.Network(5)
    for name in network.p:
        network.p[name] = network.p[name].astype(np.float64)
    laid = quality.lay_out(["Some words, some WORDS!! aaaa aaaa aaaa " * 30])
    repeat = quality.repetition(laid[0], laid[1][0], laid[1][0] + laid[2][0]).astype(float)
    grads = {k: np.zeros_like(v) for k, v in network.p.items()}
    network._add_gradient(laid, repeat, 1, grads)

    def loss():
        out = network.positions(laid[0], repeat, laid[1][0], laid[1][0] + laid[2][0])
        chunks = range(0, max(1, len(out) - quality.STRIDE), quality.STRIDE)
        pooled = np.stack([out[c:c + quality.CHUNK].max(axis=0) for c in chunks])
        return np.log1p(np.exp(-network._logit(pooled)))

    for name, g in grads.items():
        flat, values = g.reshape(-1), network.p[name].reshape(-1)
        for i in np.argsort(-np.abs(flat))[:3]:
            old = values[i]
            values[i] = old + 1e-5
            up = loss()
            values[i] = old - 1e-5
            slope = (up - loss()) / 2e-5
            values[i] = old
            assert abs(slope - flat[i]) < 1e-3 + 0.02 * abs(slope), name


def noisy_or(model, text):
    """Score, and spans of offending sentences, one word and one sentence at a time."""
    weight = dict(zip(model["keys"].tolist(), model["weights"].tolist()))
    clean, offending, sets, at = 1.0, [], set(), 0
    data = (text or "").encode()
    for part in re.findall(rb"[^.!?\n]*[.!?\n]+|[^.!?\n]+\Z", data) or [b""]:
        known = set()
        for word in re.findall(rb"[0-9A-Za-z\x80-\xff]+", part):
            known |= {int(h[0]) for h in words(np.frombuffer(word, np.uint8), toxicity.PREFIXES)[2]}
        known &= weight.keys()
        odds = model["bias"] + math.fsum(weight[h] for h in known)
        chance = 1 / (1 + math.exp(-odds))
        end = at + len(part.decode())
        if chance >= toxicity.THRESHOLD:
            offending.append((at, end))
        if frozenset(known) not in sets:
            clean *= 1 - chance
        sets.add(frozenset(known))
        at = end
    return 1 - clean, offending


def test_toxicity_against_a_plain_version(spark, sf_dir):
    """Scores and all offending sentences of the given documents."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(labelled_sample(docs, labels, "toxic", toxicity.learnable(F.col("doc_id"))))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = toxicity.score_texts(docs, model).collect()
    assert len(got) == len(texts) and any(len(r.offending) > 1 for r in got)
    for r in got:
        score, offending = noisy_or(pickle.loads(model), texts[r.doc_id])
        assert abs(r.score - score) < 1e-5
        assert [(s.start, s.end) for s in r.offending] == offending


def test_all_offending_sentences(spark, docs, corpus):
    """Two insults in a text are two spans, also after characters of several bytes."""
    rows, labels = corpus
    model = toxicity.train(spark.createDataFrame([(t, y) for (_, t), (_, _, y) in zip(rows, labels)],
                                                 "text string, label int"))
    said = ["Bada nena. ", "Ähé 東京 You vile gorx! ", "Bada nena. ", "You awful gorxen! ", "Nada."]
    r, = toxicity.score_texts(docs([(1, "".join(said))]), model).collect()
    assert ["".join(said)[s.start:s.end] for s in r.offending] == [said[1], said[3]]
    assert (r.sentence_start, r.sentence_end) in [(s.start, s.end) for s in r.offending]


def plain_quality(p, text):
    """The network's probability, one position and one filter at a time."""
    data = [max(b, 1) for b in (text or "").encode()]
    n = max(1, -(-len(data) // quality.STEP))
    data += [0] * (quality.STEP * n + quality._GAP - len(data))
    byte = lambda i: data[i] if i >= 0 else 0
    out = []
    for at in range(0, n * quality.STEP, quality.STEP):
        repeat = max(sum(byte(i) == byte(i - lag) != 0 for i in range(at, at + quality.LOOK))
                     for lag in range(1, quality.LAGS + 1)) / quality.LOOK
        window = np.concatenate([p["embed"][byte(i)] for i in range(at, at + 2 * quality.STEP)])
        out.append(window @ p["filters"] + repeat * p["repeat"] + p["bias"])
    pooled = [np.max(out[c:c + quality.CHUNK], axis=0) for c in range(0, max(1, n - quality.STRIDE), quality.STRIDE)]
    logit = np.maximum(pooled, 0).mean(axis=0) @ p["out"] + p["offset"][0]
    return 1 / (1 + math.exp(-min(30, max(-30, logit))))


def test_quality_against_a_plain_version(spark, sf_dir):
    """Scores of given documents by a trained network; lengths around one and two chunks."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(labelled_sample(docs, labels, "quality", quality.learnable(F.col("doc_id"))))
    texts = {r.doc_id: r.text for r in docs.where("length(text) < 4000").collect()}
    got = quality.score_texts(docs, model).where("length(text) < 4000").collect()
    assert len(got) == len(texts) > 20
    p = pickle.loads(model)
    assert all(abs(r.score - plain_quality(p, texts[r.doc_id])) < 1e-4 for r in got)
    network = quality.Network()
    network.p = p
    sizes = [quality.STEP * (quality.STRIDE * k + d) for k in (1, 2, 3) for d in (-1, 0, 1)]
    for text in ("".join(chr(97 + i * i % 23) for i in range(size)) for size in sizes):
        assert abs(network.score([text])[0] - plain_quality(p, text)) < 1e-4
