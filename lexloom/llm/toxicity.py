"""Toxicity by multiple-instance learning: sentences explain the label of their document."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexloom.llm.sample import labelled_sample, remainder
from lexloom.llm.store import Workspace, table
from lexloom.llm.wordhash import mix, words

THRESHOLD = 0.3
HELD_OUT_PARTS, HELD_OUT = 4, 2
#: Words of the model stand in this many texts of the sample at least.
MIN_TEXTS = 3
#: Beginnings of words, in bytes, that may carry weight besides whole words.
PREFIXES = range(4, 9)
EPOCHS, RATE, DECAY, SHRINK = 150, 0.1, 1e-5, 1e-4
#: Weight of the toxic texts of the sample; clean text is the rule.
TOXIC_SHARE = 0.25
START = -6.0  # log odds of a sentence without known words, before training

_END = np.zeros(256, bool)  # bytes that end a sentence
_END[[ord(c) for c in ".!?\n"]] = True


def sentences(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each sentence of a text's bytes.

    Runs of ``. ! ?`` and line breaks end a sentence. All bytes belong to a sentence; a text
    without bytes has one empty sentence.
    """
    ends = _END[data]
    last = np.flatnonzero(ends[:-1] & ~ends[1:]) + 1 if len(data) else np.empty(0, np.int64)
    return np.concatenate(([0], last)), np.concatenate((last, [len(data)]))


class NoisyOr:
    """Sentence log odds are a sum over words; a text is toxic unless no sentence is.

    A sentence counts by the set of its words (and beginnings of words) that the model
    knows. Sentences with the same set are one instance, so repeats add no evidence and a text
    is not likelier to offend only because it is long.
    """

    def __init__(self):
        self.keys = np.empty(0, np.uint64)  # sorted hashes of known words and beginnings
        self.weights = np.empty(0)
        self.bias = START

    def sets(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sentence and known word of each distinct pair of them, in order."""
        at, _, hashes = words(data, PREFIXES)
        if not len(self.keys) or not len(at):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        sentence = np.searchsorted(starts, at, "right") - 1
        pairs = []
        for h in hashes:
            index = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            known = np.flatnonzero(self.keys[index] == h)
            pairs.append(sentence[known] * len(self.keys) + index[known])
        pairs = np.unique(np.concatenate(pairs))
        return pairs // len(self.keys), pairs % len(self.keys)

    def instances(self, n: int, sentence: np.ndarray, index: np.ndarray) -> np.ndarray:
        """The first sentence of each distinct set of known words."""
        total = np.zeros(n, np.uint64)
        np.add.at(total, sentence, mix(self.keys[index]))
        return np.unique(total, return_index=True)[1]

    def score(self, text: str | None) -> tuple[float, float, int, int, list[tuple[int, int, float]]]:
        """Probability of the text; of its worst sentence, and that sentence's characters; all offenders.

        Offending sentences are those whose own probability reaches the threshold, in order:
        their first character, the one after their last, and the probability.
        """
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        starts, ends = sentences(data)
        sentence, index = self.sets(data, starts)
        odds = self.bias + np.bincount(sentence, self.weights[index], len(starts))
        if len(sentence):
            total = np.logaddexp(0, odds[self.instances(len(starts), sentence, index)]).sum()
        else:
            total = np.logaddexp(0, self.bias)  # minus the log of "no sentence is toxic"
        chance = 1 / (1 + np.exp(-odds))
        worst = int(odds.argmax())
        chosen = np.union1d(np.flatnonzero(chance >= THRESHOLD), [worst])
        # Characters before each place where a chosen sentence begins or ends: all but continuation bytes.
        places = np.stack((starts[chosen], ends[chosen]), axis=1)
        cuts, leads = np.unique(places), (data & 0xC0) != 0x80
        chars = np.cumsum([np.count_nonzero(leads[a:b]) for a, b in zip(np.append(0, cuts), cuts)])
        spans = chars[np.searchsorted(cuts, places)]
        start, end = spans[np.searchsorted(chosen, worst)]
        offending = [(int(a), int(b), round(float(p), 6)) for (a, b), p in zip(spans, chance[chosen])
                     if p >= THRESHOLD]
        return float(-np.expm1(-total)), float(chance[worst]), int(start), int(end), offending

    def fit(self, texts: list[str], labels: list[int]) -> None:
        """Adam with shrinkage on the log loss of documents; sentences have no labels."""
        y = np.array(labels, float)
        self.bias = START
        raw = [np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) for t in texts]
        seen = [np.unique(np.concatenate(words(d, PREFIXES)[2])) for d in raw]
        keys, times = np.unique(np.concatenate(seen or [np.empty(0, np.uint64)]), return_counts=True)
        self.keys = keys[(times >= MIN_TEXTS) & (keys != 0)]
        if not len(texts) or y.min() == y.max():
            self.keys, self.weights = self.keys[:0], np.empty(0)
            self.bias = -START if len(texts) and y.max() == 1 else START
            return
        rows, known, text_of, size = [], [], [], 0
        for i, data in enumerate(raw):
            starts, _ = sentences(data)
            sentence, index = self.sets(data, starts)
            chosen = self.instances(len(starts), sentence, index)
            new = np.full(len(starts), -1)
            new[chosen] = np.arange(len(chosen)) + size
            kept = new[sentence] >= 0
            rows.append(new[sentence][kept])
            known.append(index[kept])
            text_of.append(np.full(len(chosen), i))
            size += len(chosen)
        rows, known, text_of = map(np.concatenate, (rows, known, text_of))
        balance = np.where(y == 1, TOXIC_SHARE / y.sum(), (1 - TOXIC_SHARE) / (len(y) - y.sum()))
        self.weights = np.zeros(len(self.keys))
        m, v = np.zeros(len(self.keys) + 1), np.zeros(len(self.keys) + 1)
        for step in range(1, EPOCHS + 1):
            odds = self.bias + np.bincount(rows, self.weights[known], size)
            total = np.bincount(text_of, np.logaddexp(0, odds), len(texts))
            # d loss / d total: 1 for clean texts, -P(clean) / P(toxic) for toxic ones.
            slope = np.where(y == 1, -1 / np.maximum(np.expm1(np.minimum(total, 500)), 1e-6), 1.0)
            g = (slope * balance)[text_of] / (1 + np.exp(-np.clip(odds, -500, 500)))
            grad = np.append(np.bincount(known, g[rows], len(self.keys)), g.sum())
            grad[:-1] += DECAY * self.weights
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            scale = RATE / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-5)
            move = scale * m / (1 - 0.9 ** step)
            moved = self.weights - move[:-1]
            self.weights = np.sign(moved) * np.maximum(np.abs(moved) - scale[:-1] * SHRINK, 0)
            self.bias -= move[-1]
        used = np.flatnonzero(self.weights)
        self.keys, self.weights = self.keys[used], self.weights[used]


def train(sample: DataFrame) -> bytes:
    """A model fitted to a bounded ``text, label`` sample in one task.

    Its words are those of the sample, so what comes to the driver is bounded as well.
    """

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["text"], r["label"]) for b in batches for r in b.to_pylist())
        model = NoisyOr()
        model.fit([t for t, _ in rows], [y for _, y in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(model))], pa.binary())],
                                         names=["model"])

    row = sample.select("text", "label").coalesce(1).mapInArrow(fit, "model binary").first()
    if row:
        return row.model
    model = NoisyOr()  # no rows, so no task ran
    model.fit([], [])
    return pickle.dumps(vars(model))


def score_texts(docs: DataFrame, model: bytes) -> DataFrame:
    """``doc_id``, ``score``, the likeliest offending sentence of every text and all that offend."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = NoisyOr()
        vars(scorer).update(pickle.loads(model))
        for batch in batches:
            rows = [scorer.score(x.as_py()) for x in batch.column(1)]
            total, worst, start, end, offending = zip(*rows) if rows else ((), (), (), (), ())
            offending = [[dict(zip(("start", "end", "score"), s)) for s in spans] for spans in offending]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.round(total, 6), pa.float64()),
                 pa.array(np.round(worst, 6), pa.float64()), pa.array(start, pa.int64()),
                 pa.array(end, pa.int64()), pa.array(offending, pa.list_(span))],
                names=["doc_id", "score", "sentence_score", "sentence_start", "sentence_end", "offending"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, sentence_score double, "
             "sentence_start long, sentence_end long, "
             "offending array<struct<start: long, end: long, score: double>>")


def learnable(doc_id: Column) -> Column:
    """Rows that may be learned from: all but the held-out quarter."""
    return remainder(doc_id, HELD_OUT_PARTS) != HELD_OUT


def toxicity_scores(docs: DataFrame, labels: DataFrame, work: Workspace | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the offending sentences of every row of ``docs``.

    The model learns from the labels of a bounded sample of documents outside the held-out
    quarter: a document is clean only if each of its sentences is (noisy-or). It then scores
    whole texts and names the sentence that is likeliest to offend (``sentence_score``, and its
    characters from ``sentence_start`` to before ``sentence_end``; the first of equals). ``offending``
    lists all sentences whose own score reaches ``THRESHOLD``: ``start, end, score`` in text
    order, so it can be empty in a text of many doubtful ones. Only the text is an input.

    Null and empty texts have one empty sentence. Null ids are scored, with a null
    ``held_out``. Repeated rows stay. Without any label of a class all scores are alike.
    An empty table gives an empty result. Other columns are not read.
    """
    sample = labelled_sample(docs, labels, "toxic", learnable(F.col("doc_id")))
    scored = score_texts(docs, train(sample))
    return scored.select("doc_id", (remainder(F.col("doc_id"), HELD_OUT_PARTS) == HELD_OUT)
                         .alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
                         "sentence_score", "sentence_start", "sentence_end", "offending")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
