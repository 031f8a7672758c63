"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lexloom.llm.sample import labelled_sample, remainder
from lexloom.llm.store import Workspace, carried, table

THRESHOLD = 0.3
HELD_OUT_PARTS, HELD_OUT = 5, 0
SIZE = 8  # numbers that stand for a byte
STEP = 4  # bytes from one position to the next; a filter sees two steps
FILTERS = 24
CHUNK = 256  # positions that are max-pooled together
STRIDE = 128  # positions from one chunk to the next, half a chunk: every position is in two
LAGS = 40  # the repetition input looks so many bytes back
LOOK = 32  # and compares so many bytes from a position on
STEPS, BATCH, RATE = 350, 64, 0.01
_GAP = 64  # zero bytes between texts: no filter or lag reaches from one into the next
_BLOCK = 1 << 14  # positions computed at once


def lay_out(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of several texts with gaps between them; first position and positions of each.

    Zero bytes of a text become ones, so that a zero always is a gap.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    counts = np.array([max(1, -(-len(r) // STEP)) for r in raw])
    first = np.cumsum(np.concatenate(([0], counts[:-1] + _GAP // STEP))) + _GAP // STEP
    data = np.zeros((first[-1] + counts[-1]) * STEP + _GAP, np.uint8)
    for r, at in zip(raw, first * STEP):
        data[at:at + len(r)] = np.maximum(np.frombuffer(r, np.uint8), 1)
    return data, first, counts


def repetition(data: np.ndarray, start: int, stop: int) -> np.ndarray:
    """For positions ``start`` to ``stop``: how far the next bytes repeat those some lag before.

    The largest share, over lags of 1 to ``LAGS`` bytes, of the following ``LOOK`` bytes that
    equal the byte a lag before them.
    """
    low, high = start * STEP, stop * STEP + LOOK - STEP
    here = data[low:high]
    text, best = here != 0, np.zeros(stop - start, np.uint32)
    width = LOOK // STEP
    for lag in range(1, LAGS + 1):
        same = (here == data[low - lag:high - lag]) & text
        fours = (same.view(np.uint32) * np.uint32(0x01010101)) >> np.uint32(24)
        sums = np.cumsum(np.concatenate((np.zeros(1, np.uint32), fours)), dtype=np.uint32)
        np.maximum(best, sums[width:] - sums[:-width], out=best)
    return best.astype(np.float32) / LOOK


def _halves(out: np.ndarray) -> np.ndarray:
    """The maximum of every ``STRIDE`` positions."""
    return np.maximum.reduceat(out, np.arange(0, len(out), STRIDE), axis=0)


def _chunks(halves: np.ndarray) -> np.ndarray:
    """The maxima of overlapping chunks, two halves each; a text of one half is one chunk."""
    return np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves


class Network:
    """Byte embedding, filters over two steps, max over overlapping chunks, mean over these, one logit."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
        self.p = {
            "embed": normal(256, SIZE) * 0.5,
            "filters": normal(2 * STEP * SIZE, FILTERS) / np.sqrt(2 * STEP * SIZE).astype(np.float32),
            "repeat": normal(FILTERS) * 0.5,
            "bias": np.zeros(FILTERS, np.float32),
            "out": normal(FILTERS) / np.sqrt(FILTERS).astype(np.float32),
            "offset": np.zeros(1, np.float32),
        }
        self.p["embed"][0] = 0

    def positions(self, data: np.ndarray, repeat: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Filter outputs at positions ``start`` to ``stop``."""
        p, half = self.p, STEP * SIZE
        steps = p["embed"][data[start * STEP:(stop + 1) * STEP]].reshape(-1, half)
        out = steps[:-1] @ p["filters"][:half]
        out += steps[1:] @ p["filters"][half:]
        out += repeat[:, None] * p["repeat"] + p["bias"]
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1 for each text."""
        data, first, counts = lay_out(texts)
        logits = np.empty(len(texts))
        # Texts next to each other share a block; a long one is taken in several.
        i = 0
        while i < len(texts):
            j = i + 1
            while j < len(texts) and first[j] + counts[j] - first[i] <= _BLOCK:
                j += 1
            begin, end = first[i], first[j - 1] + counts[j - 1]
            pooled = []
            for at in range(begin, end, _BLOCK):  # _BLOCK is a multiple of CHUNK
                to = min(end, at + _BLOCK)
                out = self.positions(data, repetition(data, at, to), at, to)
                if j - i == 1:
                    pooled.append(_halves(out))
            if j - i == 1:
                logits[i] = self._logit(_chunks(np.concatenate(pooled)))
            else:
                for k in range(i, j):
                    own = out[first[k] - begin:first[k] - begin + counts[k]]
                    logits[k] = self._logit(_chunks(_halves(own)))
            i = j
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))

    def _logit(self, pooled: np.ndarray) -> float:
        return float(np.maximum(pooled, 0).mean(axis=0) @ self.p["out"] + self.p["offset"][0])

    def fit(self, texts: list[str], labels: list[int], seed: int = 0) -> None:
        """Adam on the log loss, in batches that hold both classes in equal parts."""
        rng = np.random.default_rng(seed)
        by_class = [np.flatnonzero(np.array(labels) == v) for v in (0, 1)]
        if not len(by_class[0]) or not len(by_class[1]):
            self.p["out"][:] = 0
            self.p["offset"][:] = 0 if not len(texts) else (4.0 if len(by_class[1]) else -4.0)
            return
        laid = [lay_out([t]) for t in texts]
        repeats = [repetition(d, f[0], f[0] + n[0]) for d, f, n in laid]
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, STEPS + 1):
            grads = {k: np.zeros_like(v) for k, v in self.p.items()}
            picked = np.concatenate([rng.choice(c, BATCH // 2) for c in by_class])
            for i in picked:
                self._add_gradient(laid[i], repeats[i], labels[i], grads)
            for k, g in grads.items():
                g /= BATCH
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                self.p[k] -= (RATE * mean[k] / (1 - 0.9 ** step)
                              / (np.sqrt(square[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
            self.p["embed"][0] = 0

    def _add_gradient(self, laid, repeat, label, grads) -> None:
        """Only the position that won the maximum of a chunk passes a gradient back."""
        p, half = self.p, STEP * SIZE
        data, first, counts = laid
        begin, n = first[0], counts[0]
        out = self.positions(data, repeat, begin, begin + n)
        chunks = np.arange(0, max(1, n - STRIDE), STRIDE)
        where = np.stack([c + out[c:c + CHUNK].argmax(axis=0) for c in chunks])
        top = np.take_along_axis(out, where, axis=0)
        hidden = np.maximum(top, 0).mean(axis=0)
        logit = hidden @ p["out"] + p["offset"][0]
        error = np.float32(1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label)
        grads["out"] += error * hidden
        grads["offset"] += error
        back = (error / len(chunks)) * p["out"] * (top > 0)
        grads["bias"] += back.sum(axis=0)
        grads["repeat"] += (back * repeat[where]).sum(axis=0)
        used = data[((begin + where) * STEP)[..., None] + np.arange(2 * STEP)]
        inputs = p["embed"][used].reshape(len(chunks), FILTERS, 2 * half)
        grads["filters"] += np.einsum("cfi,cf->if", inputs, back)
        np.add.at(grads["embed"], used.reshape(-1),
                  (back[..., None] * p["filters"].T[None]).reshape(-1, SIZE))


def train(sample: DataFrame) -> bytes:
    """A network fitted to a bounded ``text, label`` sample, in one task; pickled parameters.

    Only the parameters, of a fixed size, come to the driver.
    """

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["text"], r["label"]) for b in batches for r in b.to_pylist())
        network = Network()
        network.fit([t for t, _ in rows], [y for _, y in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(network.p)], pa.binary())],
                                         names=["model"])

    row = sample.select("text", "label").coalesce(1).mapInArrow(fit, "model binary").first()
    if row:
        return row.model
    model = Network()  # no rows, so no task ran
    model.fit([], [])
    return pickle.dumps(model.p)


def score_texts(docs: DataFrame, model: bytes, name: str = "score", text_column: str = "text") -> DataFrame:
    """``docs`` with a column ``name``: the probability that the whole text has label 1."""
    kept = [c for c in docs.columns if c != name]
    text = kept.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network()
        network.p = pickle.loads(model)
        for batch in batches:
            texts, scores, start = batch.column(text), [], 0
            while start < batch.num_rows:
                group, size = [], 0
                while start < batch.num_rows and size < 1 << 20:
                    group.append(texts[start].as_py())
                    size += len(group[-1] or "")
                    start += 1
                scores.append(network.score(group))
            found = np.round(np.concatenate(scores or [np.empty(0)]), 6)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())],
                                             names=[*kept, name])

    inner = docs.select(*kept)
    schema = StructType([*inner.schema.fields, StructField(name, DoubleType())])
    return inner.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: bytes) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; same columns, whatever their names."""
    there, back = carried(docs)
    scored = score_texts(docs.select(*there), model, "score", f"_c{docs.columns.index('text')}")
    return scored.where(F.col("score") >= THRESHOLD).select(*back)


def learnable(doc_id: Column) -> Column:
    """Rows that may be learned from: all but the held-out fifth."""
    return remainder(doc_id, HELD_OUT_PARTS) != HELD_OUT


def quality_scores(docs: DataFrame, labels: DataFrame, work: Workspace | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs`` (``doc_id, text, ...``).

    The network is trained on a bounded sample (``SAMPLE_ROWS`` of each class, texts up to
    ``SAMPLE_BYTES``) outside the held-out fifth and then scores each whole text: all positions,
    max-pooled by overlapping chunk, averaged over the chunks. Only the text is an input.

    Null and empty texts are scored as an empty text. Null ids are scored, with a null
    ``held_out``. Repeated rows stay. Without any label of a class all scores are alike.
    An empty table gives an empty result. Other columns are not read.
    """
    sample = labelled_sample(docs, labels, "quality", learnable(F.col("doc_id")))
    scored = score_texts(docs.select("doc_id", F.col("text").cast("string").alias("text")),
                         train(sample))
    return scored.select("doc_id", (remainder(F.col("doc_id"), HELD_OUT_PARTS) == HELD_OUT)
                         .alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
