"""Joins and numbering that hold at any size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import ArrowUDFType

from lexloom.storage import keep

# A lookup table is broadcast up to this many rows and bytes of text.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 * 1024 * 1024
# Input splits of a numbered scan; a row for each is broadcast (some 60 bytes).
MOST_SPLITS = 4_000_000


def fits_broadcast(table: DataFrame, max_rows: int = BROADCAST_ROWS,
                   max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a stored table is counted and measured small enough for every executor."""
    sizes = [F.lit(0)]
    for name, kind in table.dtypes:
        if kind == "string":
            sizes.append(F.coalesce(F.octet_length(name), F.lit(0)))
        elif kind == "array<string>":
            sizes.append(F.coalesce(F.octet_length(F.array_join(name, " ")), F.lit(0)))
    rows = table.limit(max_rows + 1).select(sum(sizes[1:], sizes[0]).cast("long").alias("bytes"))
    found = rows.agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes")).first()
    return found.rows <= max_rows and (found.bytes or 0) <= max_bytes


def lookup_join(rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left",
                max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join many rows to a table with one row per key.

    ``how`` is ``left`` or ``inner``. A table measured to be small is broadcast and
    the rows do not move. Otherwise both sides are shuffled once and merged, and adaptive
    execution splits a partition in which a hot key has very many rows. The hint keeps Spark from
    broadcasting the table after all, which it would do by its size as compressed files.

    The table is measured first, so pass one that is stored (see ``keep``).
    """
    if fits_broadcast(table, max_rows):
        return rows.join(F.broadcast(table), list(on), how)
    return rows.join(table.hint("merge"), list(on), how)


def number_sorted(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Number rows 1, 2, 3 ... in the order of unique keys, without a single-task sort.

    Rows are range-partitioned and sorted, numbered inside each partition, and
    shifted by the sizes of the partitions before theirs.
    """
    part = F.spark_partition_id()
    placed = keep(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_part", part)
        .withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)),
        "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy("_part").agg(F.count("*").alias("_n"))
              .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    # One row per shuffle partition, so the broadcast is bounded by that setting.
    return (placed.join(F.broadcast(starts), "_part")
            .withColumn(name, F.col("_start") + F.col("_at") + 1)
            .drop("_part", "_at", "_start"))


def _segments(batch: pa.RecordBatch) -> list[tuple[int, int]]:
    """Ranges of rows with the same file and block."""
    n = batch.num_rows
    if n < 2:
        return [(0, n)] if n else []
    change = np.zeros(n - 1, bool)
    for name in ("file", "block"):
        column = batch.column(name)
        change |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    edges = np.concatenate(([0], np.flatnonzero(change) + 1, [n]))
    return list(zip(edges[:-1].tolist(), edges[1:].tolist()))


def _last_event(events: np.ndarray, before: int) -> np.ndarray:
    """For each line and the end: the last event that is not 0 before it."""
    at = np.where(events != 0, np.arange(1, len(events) + 1), 0)
    filled = np.maximum.accumulate(np.concatenate(([0], at)))
    return np.where(filled > 0, np.concatenate(([before], events))[filled], before)


def _starts(events: np.ndarray, before: np.ndarray, every: bool) -> np.ndarray:
    return (events > 0) & (every | (before < 0))


def numbered_lines(lines: DataFrame, events, every: bool, header=None,
                   most: int = MOST_SPLITS, read_header=None) -> DataFrame:
    """Number the units that scanned lines belong to, inside each file, without moving a line.

    ``lines`` come straight from a scan: ``file``, ``block`` (start of the input split) and
    ``value``. ``events`` gives for an Arrow array of lines 1 where a line opens a unit, -1
    where it closes one, else 0. With ``every`` each opening is a new unit, else only one that
    follows a closing line or the file's start. ``sent_id`` counts the units up to a line;
    ``inside`` says whether the line stands after an opening. ``header``, if given, picks a text
    from lines; ``header`` of a line is the first one of its file. ``read_header``, a function of
    columns, reads it once for each split. A column ``mark`` of the lines stands in for
    ``value`` in ``events``, where these need less than the whole line.

    A first pass sums up each split: its units (if it begins outside or inside one) and its last
    event. The second continues from the splits before it. There is a small row per
    split, so these are always broadcast, up to ``most``; with more, read larger splits.
    """
    mark = "mark" if "mark" in lines.columns else "value"

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = []
        for batch in batches:
            found = events(batch.column(mark))
            texts = header(batch.column("header")) if header else None
            done = []
            for start, stop in _segments(batch):
                key = (batch.column("file")[start].as_py(), batch.column("block")[start].as_py())
                if not now or now[:2] != list(key):
                    if now:
                        done.append(now)
                    now = [*key, 0, 0, 0, None]  # units from outside, from inside, last event, header
                for place, incoming in ((2, -1), (3, 1)):
                    state = _last_event(found[start:stop], now[4] or incoming)
                    now[place] += int(_starts(found[start:stop], state[:-1], every).sum())
                now[4] = int(_last_event(found[start:stop], now[4])[-1])
                if texts is not None and now[5] is None:
                    now[5] = next((t for t in texts.slice(start, stop - start).drop_null().to_pylist()), None)
            if done:
                yield _rows(done)
        if now:
            yield _rows([now])

    # Only what the counts need goes to Python: a hash of the file, not its path with every line.
    file = F.xxhash64("file").alias("file")
    comment = [F.when(F.startswith("value", F.lit("<!--")), F.col("value")).alias("header")] if header else []
    splits = keep(lines.select(file, "block", mark, *comment).mapInArrow(
        summary, "file long, block long, out long, ins long, event int, header string"), "splits")
    if splits.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} input splits: raise spark.sql.files.maxPartitionBytes")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file").orderBy("block").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    placed = splits.withColumn("_in", F.coalesce(F.last(
        F.when(F.col("event") != 0, F.col("event")), True).over(before), F.lit(-1)))
    placed = placed.withColumn("_n", F.when(F.col("_in") > 0, F.col("ins")).otherwise(F.col("out")))
    placed = keep(placed.select(
        F.col("file").alias("_file"), "block", F.col("_in").cast("int").alias("_in"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.first("header", True).over(whole).alias("header")), "starts")
    if read_header:
        placed = placed.withColumn("header", read_header(F.col("header")))

    def number(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        last, count, state = None, 0, -1
        for files, blocks, starts, incoming, marks in batches:
            found = events(marks)
            numbers, inside = np.empty(len(marks), np.int64), np.empty(len(marks), bool)
            batch = pa.RecordBatch.from_arrays([files, blocks], names=["file", "block"])
            for start, stop in _segments(batch):
                key = (files[start].as_py(), blocks[start].as_py())
                if key != last:
                    last = key
                    count, state = starts[start].as_py(), incoming[start].as_py()
                states = _last_event(found[start:stop], state)
                steps = np.cumsum(_starts(found[start:stop], states[:-1], every))
                numbers[start:stop] = count + steps
                inside[start:stop] = states[1:] > 0
                count, state = int(numbers[stop - 1]), int(states[-1])
            yield pa.array(np.where(inside, numbers, -1 - numbers))

    # The lines stay where they are; one number comes back for each, below zero outside. It depends on the
    # lines before, so it must not be moved, copied or run on fewer lines.
    numbered = F.arrow_udf(number, "long", ArrowUDFType.SCALAR_ITER).asNondeterministic()
    known = lines.withColumn("_file", F.xxhash64("file")).join(
        F.broadcast(placed), ["_file", "block"], "left")
    checked = F.when(F.col("_start").isNotNull(), F.col("_start")).otherwise(F.raise_error(F.lit(
        "input splits changed between passes; fix spark.sql.files.minPartitionNum")).cast("long"))
    at = F.col("_at")
    return known.withColumn("_at", numbered("_file", "block", checked, "_in", mark)).select(
        "file", "header", F.when(at < 0, -1 - at).otherwise(at).alias("sent_id"), (at >= 0).alias("inside"), "value")


def _rows(found: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)],
                                      names=["file", "block", "out", "ins", "event", "header"])
