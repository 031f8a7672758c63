"""Vectors as short codes: one codebook for each part, refined with adaptive distance bounds."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexloom.llm.store import Workspace, table

SCALE = 4096
PARTS = 8
ENTRIES = 16  # at most 256: a code is two hexadecimal digits
ROUNDS = 6
#: Vectors in a block, and numbers in it.
BLOCK, BLOCK_NUMBERS = 2048, 1 << 19
#: Label sums up to this many rows are broadcast; more are shuffled.
BROADCAST_ROWS = 500_000
_EXACT = 1 << 53  # whole numbers below this are exact in floating point
_MOST = (1 << 63) - 1
_SLACK = 1e-12  # far above the rounding errors of a root or a sum


def _down(x: np.ndarray) -> np.ndarray:
    """Short floating point numbers that are not above ``x``."""
    x = x - np.abs(np.where(np.isfinite(x), x, 0)) * _SLACK
    with np.errstate(over="ignore"):
        y = x.astype(np.float32)
    return np.where(y > x, np.nextafter(y, np.float32(-np.inf)), y)


def _up(x: np.ndarray) -> np.ndarray:
    """Short floating point numbers that are not below ``x``."""
    x = x + np.abs(np.where(np.isfinite(x), x, 0)) * _SLACK
    with np.errstate(over="ignore"):
        y = x.astype(np.float32)
    return np.where(y < x, np.nextafter(y, np.float32(np.inf)), y)


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of vectors (n, w) to entries (k, w) or to their own (n, m, w)."""
    if entries.ndim == 3:
        difference = x[:, None, :] - entries
        return (difference * difference).sum(axis=2)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T)
            + (entries * entries).sum(axis=1)[None, :])


class Bounds:
    """What is known of the distances of a block's vectors to one codebook.

    ``code`` is the nearest entry and ``upper`` not below the distance to it. ``near`` holds the
    ``b`` next closest entries as of the last look, with lower bounds in ascending order, and ``outer``
    is one lower bound for all other entries.
    """

    def __init__(self, code, upper, near, lower, outer):
        self.code, self.upper, self.near, self.lower, self.outer = code, upper, near, lower, outer

    @classmethod
    def unknown(cls, n: int, b: int) -> "Bounds":
        return cls(np.zeros(n, np.uint8), np.full(n, np.inf, np.float32), np.zeros((n, b), np.uint8),
                   np.full((n, b), -np.inf, np.float32), np.full(n, -np.inf, np.float32))

    def _look(self, rows: np.ndarray, x: np.ndarray, entries: np.ndarray) -> int:
        """Measure the distances of some rows to all entries."""
        b = self.near.shape[1]
        d = _distances(x[rows], entries)
        order = np.argsort(d, axis=1, kind="stable")  # ties to the lower index
        roots = np.sqrt(np.take_along_axis(d, order[:, :b + 2], axis=1).astype(np.float64))
        self.code[rows] = order[:, 0]
        self.near[rows] = order[:, 1:b + 1]
        self.upper[rows] = _up(roots[:, 0])
        self.lower[rows] = _down(roots[:, 1:b + 1])
        self.outer[rows] = _down(roots[:, b + 1]) if len(entries) > b + 1 else np.inf
        return d.size

    def assign(self, x: np.ndarray, entries: np.ndarray, moves: np.ndarray) -> int:
        """Bring ``code`` up to date after the entries moved so far; returns the distances measured.

        A vector whose upper bound is below all lower bounds keeps its entry. For the others its own
        distance is measured; if that is not enough, exactly the entries whose bounds it
        reaches are compared in whole numbers, and all of them where it reaches ``outer``.
        """
        k, b = len(entries), self.near.shape[1]
        if not np.isfinite(moves).all():
            self.__dict__ |= Bounds.unknown(len(x), b).__dict__
            moves = np.zeros(k)
        with np.errstate(invalid="ignore"):
            self.upper = _up(self.upper.astype(np.float64) + moves[self.code])
            bounds = np.concatenate((self.lower.astype(np.float64) - moves[self.near],
                                     self.outer.astype(np.float64)[:, None] - moves.max(initial=0)), axis=1)
        # An entry's bound may not be above that of a later one.
        bounds = _down(np.minimum.accumulate(bounds[:, ::-1], axis=1)[:, ::-1])
        self.lower, self.outer = bounds[:, :b].copy(), bounds[:, b].copy()
        unsure = np.flatnonzero(self.upper >= bounds[:, 0])
        measured = len(unsure)
        known = unsure[np.isfinite(self.upper[unsure])]
        self.upper[known] = _up(np.sqrt(_distances(
            x[known], entries[self.code[known]][:, None, :])[:, 0].astype(np.float64)))
        reached = (self.upper[unsure][:, None] >= bounds[unsure]).sum(axis=1)
        for m in range(1, b + 1):
            rows = unsure[reached == m]
            if not len(rows):
                continue
            choice = np.concatenate((self.code[rows][:, None], self.near[rows, :m]), axis=1)
            d = _distances(x[rows], entries[choice])
            order = np.lexsort((choice, d), axis=1)
            choice, d = (np.take_along_axis(a, order, axis=1) for a in (choice, d))
            roots = np.sqrt(d.astype(np.float64))
            self.code[rows], self.upper[rows] = choice[:, 0], _up(roots[:, 0])
            self.near[rows, :m], self.lower[rows, :m] = choice[:, 1:], _down(roots[:, 1:])
            measured += m * len(rows)
        rows = unsure[reached > b]
        if len(rows):
            measured += self._look(rows, x, entries)
        self._shrink(max(-(-k // 8), min(b, int(reached.max(initial=0)))))
        return measured

    def _shrink(self, b: int) -> None:
        """Keep bounds for the first ``b`` entries only."""
        if b < self.near.shape[1]:
            self.outer = np.minimum(self.outer, self.lower[:, b:].min(axis=1))
            self.near, self.lower = self.near[:, :b].copy(), self.lower[:, :b].copy()


def _whole(x: np.ndarray) -> np.ndarray:
    """Python's whole numbers, for values beyond exact floating point."""
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def _nearest_whole(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Nearest entries and distances in Python's whole numbers, a row at a time."""
    codes, errors = [], []
    for row in x:
        d = [sum(int(a) for a in (row - e) ** 2) for e in entries]
        codes.append(d.index(min(d)))
        errors.append(min(d))
    return np.array(codes, np.uint8).reshape(-1), errors


def _exact(x: np.ndarray, entries: Sequence[list[int]], width: int) -> bool:
    """Whether all distances, and sums over the block, are exact in floating point."""
    most = max(float(np.abs(x).max(initial=0)),
               float(max((abs(v) for e in entries for v in e), default=0)))
    return most < _EXACT and max(width, 1) * (2 * int(most)) ** 2 < _EXACT and len(x) * int(most) < _EXACT


def _digits(sums: np.ndarray) -> np.ndarray:
    """Sums (object) as signed numbers to the base 2^32, lowest first, one row for each digit."""
    out = []
    while True:
        if all(-(1 << 31) <= v < 1 << 31 for v in sums):
            return np.array([*out, sums.astype(np.int64)], np.int64)
        out.append((sums & 0xFFFFFFFF).astype(np.int64))
        sums = sums >> 32


Codebooks = list[list[list[int]]]  # part, entry, component


def _moves(old: Codebooks, new: Codebooks) -> list[np.ndarray]:
    """How far each entry moved, rounded up."""
    def length(a: list[int], b: list[int]) -> float:
        d = sum((x - y) ** 2 for x, y in zip(a, b))
        return math.sqrt(d) * (1 + _SLACK) if d < 1 << 1000 else math.inf

    return [np.array([length(a, b) for a, b in zip(*pair)]) for pair in zip(old, new)]


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, scale: int):
    """Blocks of vectors, floored and filled to ``dim``, with the columns that go along."""
    size = max(1, min(BLOCK, BLOCK_NUMBERS // max(dim, 1)))
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            vectors = part.column(0)
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            values = np.zeros((part.num_rows, dim))
            values[np.arange(dim)[None, :] < lengths[:, None]] = vectors.flatten().to_numpy(
                zero_copy_only=False)
            yield np.floor(values * scale), part.columns[1:]


_STATE = ("vectors binary, code binary, upper binary, near binary, lower binary, outer binary, "
          "b array<int>, measured long, sums binary, counts binary")


def _packed(vectors: np.ndarray) -> bytes:
    """Two or four bytes a number where they suffice, else eight; the length tells which."""
    most = np.abs(vectors).max(initial=0)
    return vectors.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64).tobytes()


def _unpacked(data: bytes, n: int, dim: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32}.get(len(data) // max(1, n * dim), np.float64)
    return np.frombuffer(data, kind).reshape(n, dim).astype(np.float64)


def _round(vectors: np.ndarray, known: list[Bounds], books: Codebooks,
           moves: list[np.ndarray]) -> tuple[list[Bounds], int, bytes, bytes]:
    """One round over a block: its new bounds, distances measured, sums and counts by entry."""
    n, parts = len(vectors), len(books)
    width, k = vectors.shape[1] // parts, len(books[0])
    measured, sums, counts = 0, np.zeros((parts, k, width), object), np.zeros((parts, k), np.int64)
    for p, book in enumerate(books):
        x = vectors[:, p * width:(p + 1) * width]
        if _exact(x, book, width):
            measured += known[p].assign(x, np.array(book, np.float64).reshape(k, width), moves[p])
            for j in range(width):
                sums[p, :, j] = np.bincount(known[p].code, x[:, j], k).astype(np.int64)
        else:
            fresh = Bounds.unknown(n, known[p].near.shape[1])
            whole, entries = _whole(x), np.array(book, object).reshape(k, width)
            fresh.code, _ = _nearest_whole(whole, entries)
            np.add.at(sums[p], fresh.code, whole)
            known[p], measured = fresh, measured + n * k
        counts[p] = np.bincount(known[p].code, minlength=k)
    # Python's whole numbers, as numpy's do not shift beyond a long.
    flat = np.array([int(v) for v in sums.ravel()], object)
    return known, measured, _digits(flat).tobytes(), counts.tobytes()


def _state_columns(vectors: np.ndarray, known: list[Bounds], measured: int, sums: bytes,
                   counts: bytes) -> list[pa.Array]:
    join = lambda name: b"".join(np.ascontiguousarray(getattr(b, name)).tobytes() for b in known)
    return [pa.array([x], pa.binary()) for x in (
        _packed(vectors), join("code"), join("upper"), join("near"), join("lower"), join("outer"))] + [
        pa.array([[b.near.shape[1] for b in known]], pa.list_(pa.int32())),
        pa.array([measured], pa.int64()), pa.array([sums], pa.binary()), pa.array([counts], pa.binary())]


def _state(row: dict, n: int, dim: int) -> tuple[np.ndarray, list[Bounds]]:
    """A block's vectors and bounds as they were stored."""
    known, at, parts = [], 0, len(row["b"])
    code = np.frombuffer(row["code"], np.uint8).reshape(parts, n)
    upper, outer = (np.frombuffer(row[name], np.float32).reshape(parts, n) for name in ("upper", "outer"))
    near, lower = np.frombuffer(row["near"], np.uint8), np.frombuffer(row["lower"], np.float32)
    for p, b in enumerate(row["b"]):
        known.append(Bounds(code[p].copy(), upper[p].copy(), near[at:at + n * b].reshape(n, b).copy(),
                            lower[at:at + n * b].reshape(n, b).copy(), outer[p].copy()))
        at += n * b
    return _unpacked(row["vectors"], n, dim), known


def _add_up(batches: Iterator[pa.RecordBatch], numbers: int) -> Iterator[pa.RecordBatch]:
    """Sums and counts of a task's blocks, a row for each number and digit."""
    total = np.zeros((0, numbers), np.int64)
    for batch in batches:
        for row in batch.to_pylist():
            for digits in (row["sums"], row["counts"]):
                found = np.frombuffer(digits, np.int64)
                # Counts come after the sums, as further numbers of the lowest digit.
                wide = np.zeros((1, numbers), np.int64)
                if digits is row["counts"]:
                    wide[0, numbers - len(found):] = found
                else:
                    each = numbers - len(row["counts"]) // 8
                    wide = np.zeros((len(found) // max(each, 1), numbers), np.int64)
                    wide[:, :each] = found.reshape(-1, each) if each else 0
                if len(wide) > len(total):
                    total = np.concatenate((total, np.zeros((len(wide) - len(total), numbers), np.int64)))
                total[:len(wide)] += wide
    digit, at = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(digit, pa.int64()),
                                      pa.array(total[digit, at], pa.int64())], names=["at", "digit", "value"])


def _means(state: DataFrame, books: Codebooks) -> Codebooks:
    """The next codebooks: floored means of each entry's parts; unused entries stay.

    One number for each component of an entry comes to the driver, however many vectors there are.
    """
    parts, k, width = len(books), len(books[0]), len(books[0][0])
    numbers = parts * k * (width + 1)
    found = (state.select("sums", "counts").mapInArrow(
        lambda it: _add_up(it, numbers), "at long, digit long, value long")
        .groupBy("at", "digit").agg(F.sum("value").alias("value")).collect())
    sums = [0] * numbers
    for row in found:
        sums[row["at"]] += row["value"] << (32 * row["digit"])
    counts = sums[parts * k * width:]
    out = []
    for p in range(parts):
        out.append([])
        for e in range(k):
            at, n = p * k + e, counts[p * k + e]
            out[p].append([s // n for s in sums[at * width:(at + 1) * width]] if n else books[p][e])
    return out


def usable(vector: Column, scale: int = SCALE) -> Column:
    """Whether a vector takes part: no null, and all components finite, also when scaled."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (
        F.abs(x * float(scale)) == math.inf))


def vector_codes(vectors: DataFrame, carry: Sequence[str] = (), parts: int = PARTS,
                 entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
                 work: Workspace | None = None) -> tuple[DataFrame, Codebooks]:
    """``vec_id, code, error`` of each usable vector, and the codebooks.

    ``vectors`` has ``vec_id`` and ``embedding``; the columns named in ``carry`` come after the id. A
    component x counts as floor(``scale`` x). Vectors are cut into ``parts`` equal parts, and each
    part has a codebook of ``entries``, first the parts of the smallest ids. In each of ``rounds`` every
    part goes to its nearest entry (squared Euclidean distance, ties to the lower index), and each
    entry becomes the floored mean of its parts; an unused one stays. At last parts are assigned once more.
    ``code`` is the entries' indexes, two hexadecimal digits each, and ``error`` the sum of the parts'
    squared distances.

    A round reads only what the bounds leave open (see ``Bounds``): for every part the ``b`` closest
    entries are stored with ordered lower bounds, and one outer bound for the rest. ``b`` starts
    at a quarter of the entries and follows, block by block, what the last round needed, down to an
    eighth. Bounds are rounded to the safe side and whatever they leave open is decided in whole
    numbers, so codes do not depend on them. Vectors never move: a round rewrites each block with its
    bounds, and only sums by entry are shuffled and collected (a number for each component of an entry).

    Vectors that are null or hold a null, NaN or infinity (also one reached by scaling) take no
    part. Null ids stay and come last among the starts; repeated ids are rows of their own, ordered by their
    vectors. Shorter vectors, and dimensions that parts do not divide, count as filled with zeros. With
    fewer vectors than entries a codebook has that many entries; an empty table gives an empty result
    and no codebooks. Errors beyond a long count as the largest long. Other columns are not read.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("take 1 to 256 entries and at least one part")
    if {"vec_id", "code", "error"} & set(carry):
        raise ValueError("vec_id, code and error are columns of the result: rename those to carry")
    spark = vectors.sparkSession
    work = work or Workspace(spark, "codes")
    carried = [f"_{i}" for i in range(len(carry))]
    rows = vectors.select(F.col("embedding").cast("array<double>").alias("vector"),
                          F.col("vec_id").cast("long").alias("id"),
                          *[F.col(c).alias(name) for c, name in zip(carry, carried)])
    rows = rows.where(usable(F.col("vector"), scale))
    kinds = dict(rows.dtypes)
    result = ", ".join(["vec_id long", *[f"`{c}` {kinds[n]}" for c, n in zip(carry, carried)],
                        "code string, error long"])
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], result), []
    width = -(-longest // parts)
    dim = width * parts
    first = [r["vector"] for r in rows.select("vector", "id").orderBy(
        F.asc_nulls_last("id"), "vector").limit(entries).collect()]
    starts = [[math.floor(x * scale) for x in v] + [0] * (dim - len(v)) for v in first]
    books = [[v[p * width:(p + 1) * width] for v in starts] for p in range(parts)]
    k = len(starts)
    with_kinds = f"ids array<long>, {''.join(f'{n} array<{kinds[n]}>, ' for n in carried)}"
    names = ["ids", *carried, *[c.split()[0] for c in _STATE.split(", ")]]

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, along in _blocks(batches, dim, scale):
            n = len(block)
            known = [Bounds.unknown(n, min(k - 1, -(-k // 4))) for _ in books]
            columns = _state_columns(block, *_round(block, known, books, [np.zeros(k)] * parts))
            lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), column) for column in along]
            yield pa.RecordBatch.from_arrays([*lists, *columns], names=names)

    def again(now: Codebooks, moves: list[np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    n = len(row.column(0)[0])
                    block, known = _state({c: row.column(c)[0].as_py() for c in names[-10:]}, n, dim)
                    columns = _state_columns(block, *_round(block, known, now, moves))
                    yield pa.RecordBatch.from_arrays([*row.columns[:1 + len(carried)], *columns],
                                                     names=names)
        return run

    path = work.path("bounds")
    state = work.keep(rows.mapInArrow(begin, with_kinds + _STATE), path=path)
    for _ in range(rounds - 1):
        following = _means(state, books)
        moves, books = _moves(books, following), following
        before, path = path, work.path("bounds")
        state = work.keep(state.mapInArrow(again(books, moves), with_kinds + _STATE), path=path)
        work.drop(before)  # the new table is stored whole, nothing goes back beyond it
    moves = [np.zeros(k)] * parts
    if rounds:
        following = _means(state, books)
        moves, books = _moves(books, following), following
    final = books

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                n = len(row.column(0)[0])
                block, known = _state({c: row.column(c)[0].as_py() for c in names[-10:]}, n, dim)
                known, *_ = _round(block, known, final, moves)
                errors = [0] * n
                for p, book in enumerate(final):
                    x = block[:, p * width:(p + 1) * width]
                    entries_of = np.array(book, np.float64 if _exact(x, book, width) else object)
                    if entries_of.dtype == object:
                        x = _whole(x)
                    difference = x - entries_of.reshape(k, width)[known[p].code]
                    errors = [e + int(d) for e, d in zip(errors, (difference * difference).sum(axis=1))]
                digits = np.stack([b.code for b in known], axis=1).tobytes().hex()
                yield pa.RecordBatch.from_arrays(
                    [*[row.column(j)[0].values for j in range(1 + len(carried))],
                     pa.array([digits[2 * parts * j:2 * parts * (j + 1)] for j in range(n)], pa.string()),
                     pa.array([min(e, _MOST) for e in errors], pa.int64())],
                    names=["vec_id", *carry, "code", "error"])

    return state.mapInArrow(finish, result), books


def codebooks_sha256(books: Codebooks) -> str:
    """Digest of all entries' decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry)
                          .encode()).hexdigest()


def with_group_sums(rows: DataFrame, group: str, value: str, name: str, work: Workspace) -> DataFrame:
    """``rows`` with the sum of ``value`` over each equal ``group``, nulls together, at most a long.

    Sums are partial before the shuffle; rows then meet them by a broadcast of a counted table or by a
    join that adaptive execution can split where a group is hot.
    """
    key = [F.col(group).isNull().alias("_none"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("_group")]
    total = F.sum(F.col(value).cast("decimal(20,0)"))
    sums = work.keep(rows.groupBy(*key).agg(F.least(total, F.lit(_MOST)).cast("long").alias(name)), "sums")
    if sums.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        sums = F.broadcast(sums)
    return rows.select("*", *key).join(sums, ["_none", "_group"]).drop("_none", "_group")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors, with the errors summed by label."""
    work = Workspace(spark, "codes")
    found, books = vector_codes(table(spark, sf_dir, "embeddings"), ["label"], work=work)
    found = with_group_sums(work.keep(found, "codes"), "label", "error", "label_error", work)
    return found.select("vec_id", "code", "error", "label_error",
                        F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
