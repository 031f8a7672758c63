"""Runs of repeated words in texts, by suffix trees, Lyndon roots and longest common extensions."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexloom.llm.store import table

LEAST = 12  # words of a run, at least
_BLOCK = 16  # numbers of a block in a range minimum
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class RangeMin:
    """Minima of ranges in constant time: a sparse table over blocks, and running minima inside them."""

    def __init__(self, values: np.ndarray):
        n = -(-max(1, len(values)) // _BLOCK) * _BLOCK
        self.values = np.full(n, np.iinfo(np.int32).max, np.int32)
        self.values[:len(values)] = values
        rows = self.values.reshape(-1, _BLOCK)
        self.to = np.minimum.accumulate(rows, axis=1).ravel()
        self.since = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [rows.min(axis=1)]
        while 2 << len(self.levels) - 1 <= len(self.levels[0]):
            last, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum of each range, both ends included."""
        first, last = low // _BLOCK, high // _BLOCK
        out = np.minimum(self.since[low], self.to[high])
        same = np.flatnonzero(first == last)
        if len(same):
            at = low[same, None] + np.arange(_BLOCK)
            inside = np.where(at <= high[same, None], self.values[np.minimum(at, len(self.values) - 1)],
                              np.iinfo(np.int32).max)
            out[same] = inside.min(axis=1)
        between = last - first - 1
        for level in range(len(self.levels)):
            rows = np.flatnonzero((between >= 1 << level) & (between < 2 << level))
            if len(rows):
                held = self.levels[level]
                out[rows] = np.minimum(out[rows], np.minimum(
                    held[first[rows] + 1], held[last[rows] - (1 << level)]))
        return out


class SuffixTree:
    """Ukkonen's suffix tree of a sequence of whole numbers above zero, with an end mark of zero.

    ``extension`` gives longest common extensions by the lowest common ancestor of two leaves: the least
    string depth between their first visits in an Euler tour. ``ranks`` orders the suffixes, the mark's first.
    """

    def __init__(self, symbols: Sequence[int]):
        text = [*symbols, 0]
        n, base = len(text), max(text) + 1
        start, stop, link, leaf_of = [0], [0], [0], []
        child: dict[int, int] = {}  # parent * base + first symbol of the edge -> node
        find = child.get
        node = edge = length = waiting = 0
        for i, c in enumerate(text):
            waiting += 1
            unlinked = 0
            while waiting:
                if not length:
                    edge = i
                key = node * base + text[edge]
                following = find(key)
                if following is None:
                    child[key] = len(start)
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    begin = start[following]
                    span = stop[following] - begin
                    if length >= span:
                        edge += span
                        length -= span
                        node = following
                        continue
                    if text[begin + length] == c:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    split = len(start)
                    start.append(begin)
                    stop.append(begin + length)
                    link.append(0)
                    child[key] = split
                    start[following] = begin + length
                    child[split * base + text[begin + length]] = following
                    child[split * base + c] = split + 1
                    if unlinked:
                        link[unlinked] = split
                    unlinked = split
                # The leaf of the next suffix; leaves come in the order of their suffixes.
                leaf_of.append(len(start))
                start.append(i)
                stop.append(n)
                link.append(0)
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self.size = n
        self._tour(start, stop, leaf_of, child, base)

    def _tour(self, start: list[int], stop: list[int], leaf_of: list[int], child: dict[int, int],
              base: int) -> None:
        keys = np.fromiter(child.keys(), np.int64, len(child))
        order = np.argsort(keys)
        ends = np.cumsum(np.bincount(keys // base, minlength=len(start)))
        kids = np.fromiter(child.values(), np.int64, len(child))[order].tolist()
        ends, at = ends.tolist(), np.concatenate(([0], ends[:-1])).tolist()
        depth = [0] * len(start)
        tour, first, path, node = [0], [0] * len(start), [], 0
        while True:
            i = at[node]
            if i < ends[node]:
                at[node] = i + 1
                below = kids[i]
                first[below] = len(tour)
                tour.append(below)
                depth[below] = depth[node] + stop[below] - start[below]
                if at[below] == ends[below]:  # a leaf
                    tour.append(node)
                else:
                    path.append(node)
                    node = below
            elif path:
                node = path.pop()
                tour.append(node)
            else:
                break
        self.first = np.array(first, np.int64)[leaf_of]
        self.least = RangeMin(np.array(depth, np.int32)[tour])
        self.ranks = np.empty(self.size, np.int64)
        self.ranks[np.argsort(self.first)] = np.arange(self.size)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``a`` and ``b`` (different places)."""
        a, b = self.first[a], self.first[b]
        return self.least(np.minimum(a, b), np.maximum(a, b)).astype(np.int64)


def _following_smaller(values: list[int]) -> np.ndarray:
    """For each place the next one with a smaller value; the length where there is none."""
    out, open_places = [len(values)] * len(values), []
    for i, value in enumerate(values):
        while open_places and values[open_places[-1]] > value:
            out[open_places.pop()] = i
        open_places.append(i)
    return np.array(out, np.int64)


def runs_of(symbols: Sequence[int], least: int = LEAST) -> np.ndarray:
    """(start, length, period) of the runs of whole numbers above zero, by start, then period.

    A run has at least ``least`` numbers and two periods. Every run holds a Lyndon word of its
    period, in the order of numbers or in the reverse one, that is the longest Lyndon word at its
    place; and the longest Lyndon word at a place ends before the next smaller suffix. So each place gives
    two candidates, and a run is a candidate that common extensions to both sides make long enough.
    """
    n = len(symbols)
    if n < max(2, least):
        return np.empty((0, 3), np.int64)
    forward, backward = SuffixTree(symbols), SuffixTree(symbols[::-1])
    ranks = forward.ranks
    place = np.tile(np.arange(n), 2)
    period = np.concatenate((_following_smaller(ranks.tolist())[:n],
                             _following_smaller((-ranks).tolist())[:n])) - place
    # In the reverse order the end mark is the greatest, so a word may seem to go beyond it.
    usable = place + period <= n
    place, period = place[usable], period[usable]
    after = np.where(place + period < n, forward.extension(place, np.minimum(place + period, n)), 0)
    # The suffix before a place, read backwards, starts at n - place of the reversal.
    before = np.where(place > 0, backward.extension(n - place, n - place - period), 0)
    length = before + period + after
    found = (length >= least) & (length >= 2 * period)
    rows = np.stack((place - before, length, period), axis=1)[found]
    return np.unique(rows[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def repeated_stretches(symbols: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches of at least ``least`` numbers outside of which there is no number of a run.

    In a run of at least ``least`` numbers and two periods, every ``least // 2`` numbers from its start on stand
    once more a period later or earlier, and those that do cover it whole. So only what such repeated groups
    cover can be in runs. Groups are compared by hashes; a false match only makes a stretch longer.
    """
    n, size = len(symbols), max(1, least // 2)
    if n < least:
        return []
    with np.errstate(over="ignore"):
        hashes = np.zeros(n - size + 1, np.uint64)
        for i in range(size):
            hashes = hashes * _FACTOR + symbols[i:n - size + 1 + i].astype(np.uint64)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    if not same.any():
        return []
    covers = np.zeros(n + 1, np.int64)
    repeated = np.unique(np.concatenate((order[1:][same], order[:-1][same])))
    covers[repeated] += 1
    np.subtract.at(covers, repeated + size, 1)
    inside = np.concatenate(([False], np.cumsum(covers)[:n] > 0, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= least]


def word_runs(words: Sequence[bytes], least: int = LEAST) -> np.ndarray:
    """(start, length, period) of all runs of a text's words, by start, then period."""
    known: dict[bytes, int] = {}
    symbols = np.array([known.setdefault(w, len(known) + 1) for w in words], np.int64)
    found = []
    for start, stop in repeated_stretches(symbols, least):
        # Small numbers keep the tree's keys small.
        _, own = np.unique(symbols[start:stop], return_inverse=True)
        runs = runs_of((own + 1).tolist(), least)
        runs[:, 0] += start
        found.append(runs)
    return np.concatenate(found) if found else np.empty((0, 3), np.int64)


def collapsed(words: Sequence[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not len(runs):
        return list(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.subtract.at(change, runs[:, 0] + runs[:, 1], 1)
    kept = np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()
    return [words[i] for i in kept]


#: Turns a row's id and words into the words to look at.
Prepare = Callable[[int | None, list[bytes]], list[bytes]]


def find_runs(docs: DataFrame, least: int = LEAST, prepare: Prepare | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row of ``docs`` (``doc_id, text, ...``).

    Words are what stands between ASCII white space, numbered from 0. ``runs`` is an array of
    ``start, length, period`` by start, then period: the stretches of at least ``least`` words and two
    periods that no neighbouring word extends, with their smallest period. ``collapsed`` is the text without the
    words that a run contains after its first period, joined by single blanks.

    Suffix trees (Ukkonen) of a stretch and of its reversal answer longest common extensions by an
    Euler tour in constant time; candidates are Lyndon roots (see ``runs_of``). Only stretches that repeated
    groups of ``least // 2`` words cover go into a tree, which loses no run. Memory follows the longest such
    stretch (some 500 bytes a word).

    A null text has no words, null or repeated ids keep their rows, an empty table gives an empty
    result, and other columns are not read. ``prepare`` may replace the words of a row first.
    """
    if least < 2:
        raise ValueError("a run has at least two words")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, starts, lengths, periods, texts, counts = [], [], [], [], [], [0]
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                words = (text.as_py() or "").encode().split()  # of bytes: ASCII white space only
                if prepare:
                    words = prepare(doc_id.as_py(), words)
                runs = word_runs(words, least)
                sizes.append(len(words))
                starts.append(runs[:, 0])
                lengths.append(runs[:, 1])
                periods.append(runs[:, 2])
                counts.append(counts[-1] + len(runs))
                texts.append(b" ".join(collapsed(words, runs)).decode())
            fields = [pa.array(np.concatenate(x), pa.int64()) for x in (starts, lengths, periods)] if sizes else (
                [pa.array([], pa.int64())] * 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(
                    pa.array(counts, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind.value_type))),
                 pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def made_periodic(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The rule of the query: every tenth id's words repeat from a place on. A null id's do not."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words in all documents, a tenth of which is made periodic."""
    found = find_runs(table(spark, sf_dir, "documents"), prepare=made_periodic)
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"),
                       period.alias("period"), ((1000 * length - F.pmod(1000 * length, period)) / period).cast("long").alias("exponent_milli"),
                       "runs_sha256", "collapsed_sha256")
