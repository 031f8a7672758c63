"""Secrets in texts: fixed shapes, and strings that look random in a sliding window."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexloom.llm.store import table

# The shapes that are found by pattern, in the order in which they are listed.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a shorter run fails, and a run is not cut
LEAST_VALUE, LEAST_ACCESS = 8, 16
BASE_KINDS = ("assign", "access", "hex")


@dataclass(frozen=True)
class CharacterClass:
    """Strings of one alphabet that are held against a limit of their own.

    A candidate is a run of ``characters`` (the inside of a pattern's brackets) of at least
    ``window``. A window is suspicious if its Shannon entropy is at least ``bits`` for each character
    and it has characters of ``groups`` of the three: a-z, A-Z, 0-9 (which words and numbers lack).
    """

    name: str
    characters: str
    window: int
    bits: float
    groups: int


#: Random strings of these alphabets have some 3.5, 4.0 and 4.2 bits in such a window.
CLASSES = (CharacterClass("hex_entropy", "0-9A-Fa-f", 24, 3.1, 2),
           CharacterClass("alnum_entropy", "0-9A-Za-z", 20, 3.7, 3),
           CharacterClass("base64_entropy", "0-9A-Za-z+/_-", 24, 3.95, 3))

#: Strings that look random and are no secrets: they are blanked out before the windows. Patterns that
#: could start anywhere in a long run look behind and never give back, so that their time stays linear.
ALLOW = (
    r"\b[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}\b",  # a UUID
    r"https?://[^\s?#\"'<>]+",  # an address up to its query
    r"\bsha(?:1|256|384|512)[-:][A-Za-z0-9+/=]+",  # a digest of public content
    r"\bdata:[a-z]+/[a-z0-9.+-]+;base64,[A-Za-z0-9+/=]+",  # an embedded picture or font
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+",  # a mail address
    # A path or name: words and numbers, each whole, joined by marks
    r"(?<![0-9A-Za-z+/_-])/?(?:[A-Za-z]++[0-9]*+|[0-9]++)(?:[/_-]++(?:[A-Za-z]++[0-9]*+|[0-9]++))+(?![0-9A-Za-z+/_-])",
)
#: Counts in an entropy are weighed in whole numbers, so that sums are exact in any order.
_UNIT = 1 << 20
#: Characters whose windows are looked at in one go; longer candidates go in overlapping pieces.
AT_ONCE = 1 << 18


def _weights(window: int) -> np.ndarray:
    """c log2(c) for each count c."""
    return np.array([round(c * math.log2(c) * _UNIT) if c else 0 for c in range(window + 2)], np.int64)


def window_sums(symbols: np.ndarray, runs: np.ndarray, window: int) -> np.ndarray:
    """For each place the sum of c log2(c), in units, over the counts in the window that ends there.

    ``symbols`` are of several runs side by side, ``runs`` gives the run of each place (ascending). A step
    of the window adds one symbol and, from the ``window``-th on, removes one: only their two counts
    change, and the sums are those changes added up. At the beginning of a run windows are shorter.
    """
    n, weights = len(symbols), _weights(window)
    place = np.arange(n)
    first = np.searchsorted(runs, runs)
    # A symbol's places within a run stand together, so a count in a window is a difference of ranks.
    key = (runs.astype(np.int64) << 21 | symbols) * (n + 1)
    held = np.sort(key + place)
    rank = np.searchsorted(held, key + place)
    entering = rank - np.searchsorted(held, key + np.maximum(place - window, 0))
    change = weights[entering + 1] - weights[entering]
    full = place - first >= window
    gone = place[full] - window
    leaving = np.searchsorted(held, key[gone] + place[full], "right") - rank[gone]
    change[full] += weights[leaving - 1] - weights[leaving]
    sums = np.cumsum(change)
    return sums - np.where(first > 0, sums[first - 1], 0)


def _suspicious(strings: Sequence[str], kind: CharacterClass) -> np.ndarray:
    """Whether the window that ends at each character is suspicious, over all strings side by side."""
    symbols = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).astype(np.int64)
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    runs = np.repeat(np.arange(len(strings)), lengths)
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    w, place = kind.window, np.arange(len(symbols))
    most = math.floor((math.log2(w) - kind.bits) * w * _UNIT)
    found = (place - starts >= w - 1) & (window_sums(symbols, runs, w) <= most)

    def within(mark: np.ndarray) -> np.ndarray:
        """How many of the window's characters are marked."""
        sums = np.concatenate(([0], np.cumsum(mark)))
        return sums[place + 1] - sums[np.maximum(place + 1 - w, 0)]

    groups = sum((within((symbols >= ord(a)) & (symbols <= ord(z))) > 0).astype(int)
                 for a, z in ("az", "AZ", "09"))
    # Alphabets and counting have high entropy too: most of their neighbours are one step apart.
    step = np.zeros(len(symbols), bool)
    step[1:] = (np.abs(np.diff(symbols)) <= 1) & (runs[1:] == runs[:-1])
    return found & (groups >= kind.groups) & (2 * within(step) < w)


def _windows(candidates: list[tuple[int, int, str]], kind: CharacterClass) -> Iterator[tuple[int, int, int]]:
    """(text number, start, end) of each stretch of suspicious windows in the candidates."""
    ends = _suspicious([s for *_, s in candidates], kind)
    at = 0
    for number, offset, string in candidates:
        hits = np.flatnonzero(ends[at:at + len(string)])
        at += len(string)
        if not len(hits):
            continue
        # Windows that touch or overlap are one stretch.
        breaks = np.flatnonzero(np.diff(hits) > kind.window)
        for low, high in zip(np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(hits) - 1]))):
            yield number, offset + int(hits[low]) - kind.window + 1, offset + int(hits[high]) + 1


def _pieces(offset: int, string: str, window: int) -> Iterator[tuple[int, str]]:
    """A candidate in pieces that overlap by a window less one, so that no window is cut."""
    for at in range(0, max(1, len(string) - window + 1), AT_ONCE):
        yield offset + at, string[at:at + AT_ONCE + window - 1]


def entropy_spans(texts: Sequence[str], classes: Sequence[CharacterClass] = CLASSES,
                  allow: Sequence[str] = ALLOW) -> list[list[tuple[int, int, str]]]:
    """For each text the (start, end, class name) of its suspicious stretches, whole and in order."""
    spared = re.compile("|".join(f"(?:{a})" for a in allow)) if allow else None
    shortest = min((c.window for c in classes), default=0)
    anything = re.compile(f"[{''.join(c.characters.rstrip('-') for c in classes)}-]{{{shortest},}}") if classes else None
    candidates: list[list[tuple[int, int, str]]] = [[] for _ in classes]
    sizes = [0] * len(classes)
    found: list[list[tuple[int, int, str]]] = [[] for _ in texts]

    def flush(c: int) -> None:
        if candidates[c]:
            for number, start, end in _windows(candidates[c], classes[c]):
                found[number].append((start, end, classes[c].name))
        candidates[c], sizes[c] = [], 0

    patterns = [re.compile(f"[{c.characters}]{{{c.window},}}") for c in classes]
    for number, text in enumerate(texts):
        if not anything or not anything.search(text):
            continue
        if spared:
            text = spared.sub(lambda m: "\0" * (m.end() - m.start()), text)
        for c, pattern in enumerate(patterns):
            for match in pattern.finditer(text):
                for offset, piece in _pieces(match.start(), match.group(), classes[c].window):
                    candidates[c].append((number, offset, piece))
                    sizes[c] += len(piece)
                    if sizes[c] >= AT_ONCE:
                        flush(c)
    for c in range(len(classes)):
        flush(c)
    return [_united(spans, classes) for spans in found]


def _united(spans: list[tuple[int, int, str]], classes: Sequence[CharacterClass]) -> list[tuple[int, int, str]]:
    """Stretches of a class that touch as one, without those inside another class's stretch."""
    out: list[tuple[int, int, str]] = []
    for kind in classes:
        whole: list[tuple[int, int, str]] = []
        for start, end, name in sorted(s for s in spans if s[2] == kind.name):
            if whole and start <= whole[-1][1]:
                whole[-1] = (whole[-1][0], max(end, whole[-1][1]), name)
            else:
                whole.append((start, end, name))
        out += [s for s in whole if not any(a <= s[0] and s[1] <= b for a, b, _ in out)]
    return sorted(out)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed shapes, in order of start and kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text)
             if m.end(2) - m.start(2) >= LEAST_VALUE]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)
              if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], BASE_KINDS.index(s[2])))


def _covered(span: tuple[int, int, str], base: list[tuple[int, int, str]]) -> bool:
    return any(a <= span[0] and span[1] <= b for a, b, _ in base)


def find_secrets(docs: DataFrame, classes: Sequence[CharacterClass] = CLASSES,
                 allow: Sequence[str] = ALLOW) -> DataFrame:
    """``doc_id, spans`` of every row of ``docs`` (``doc_id, text, ...``).

    ``spans`` is an array of ``kind, start, end`` (code points, ``end`` exclusive) in order of start, then kind
    as listed: first the fixed shapes ``assign``, ``access`` and ``hex``, then ``classes``. A fixed shape
    always stays. A class adds the stretches of its candidates in which every window of its length is
    suspicious by entropy (see ``CharacterClass``), unless a fixed shape covers them. What matches a pattern of
    ``allow``, and strings that mostly count up or down, are left out of the added ones only.

    Entropies are computed by incremental counts: a step of the window changes two counts. Texts are looked at
    whole; memory follows one batch of texts and ``AT_ONCE`` characters of candidates. A null text counts as
    empty and has no spans, null or repeated ids keep their rows, an empty table gives an empty
    result, and other columns are not read.
    """
    classes, allow = tuple(classes), tuple(allow)
    order = {name: i for i, name in enumerate([*BASE_KINDS, *[c.name for c in classes]])}
    if len(order) < len(BASE_KINDS) + len(classes):
        raise ValueError("classes need names of their own")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            rows = []
            for text, added in zip(texts, entropy_spans(texts, classes, allow)):
                base = base_spans(text)
                spans = base + [s for s in added if not _covered(s, base)]
                spans.sort(key=lambda s: (s[0], order[s[2]]))
                rows.append([{"kind": k, "start": a, "end": b} for a, b, k in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def said(spans: Column) -> Column:
    """Spans as text: ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    return find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(said(base), 256).alias("base_sha256"), said(spans).alias("spans"))
