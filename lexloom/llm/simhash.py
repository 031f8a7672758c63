"""SimHash near-duplicates found by pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexloom.llm.components import components
from lexloom.llm.store import Workspace, carried, table

BITS = 64
SEED = 42
SHINGLE = 3
DISTANCE = 2
#: Parts of the ring. With 5 parts and 2 differing bits, some two neighbouring parts agree.
PARTS = 5
#: Buckets of up to this many distinct fingerprints are compared pair by pair.
SMALL_BUCKET = 64
#: Rows of a set that is broadcast, at most; more are shuffled.
BROADCAST_ROWS = 500_000
_HASHED_AT_ONCE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles, as an unsigned number; no words: 0.

    A-Z are lower-cased, words are runs without ASCII white space, shingles count as often as
    they occur, and a text of fewer words than a shingle is one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    width = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends[width - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(ends), _HASHED_AT_ONCE):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in
                           zip(starts[at:at + _HASHED_AT_ONCE], ends[at:at + _HASHED_AT_ONCE])],
                          np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        for row in range(0, len(bits), 255):  # at most 255 ones fit a byte
            ones += bits[row:row + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(ones * 2 > len(ends), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64,
                             batch.num_rows)
        # Columns after the text go along.
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(values.view(np.int64)), *batch.columns[2:]],
            names=["doc_id", "fp", *batch.schema.names[2:]])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long) of every row."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _fingerprints, "doc_id long, fp long")


def part_widths(parts: int = PARTS) -> list[int]:
    """Bits in each part of the ring."""
    return [BITS // parts + (i < BITS % parts) for i in range(parts)]


def budgets(parts: int = PARTS, distance: int = DISTANCE) -> list[int]:
    """Most differing bits that a chain of 1, 2, ... parts may have."""
    return [length * distance // parts for length in range(1, parts + 1)]


def _part(fp: Column, start: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1))


def _chain_holds(a: Column, b: Column, first: int, parts: int, distance: int) -> Column:
    """Whether the chain from part ``first`` keeps its budget at every length."""
    widths = part_widths(parts)
    starts = [sum(widths[:i]) for i in range(parts)]
    total, holds = F.lit(0), F.lit(True)
    for length, budget in enumerate(budgets(parts, distance)):
        i = (first + length) % parts
        differing = F.bit_count(_part(a.bitwiseXOR(b), starts[i], widths[i]))
        total = total + differing
        holds = holds & (total <= budget)
    return holds


def near_links(prints: DataFrame, work: Workspace, distance: int = DISTANCE,
               parts: int = PARTS, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """Links ``a, b`` that join all distinct ``fp`` within ``distance`` bits of each other.

    Pigeonring: if two fingerprints differ in at most ``distance`` bits, then from some part of
    the ring every chain of consecutive parts keeps within its proportional share of them.
    The longest chain whose share is below one bit must agree in full and is the key of a hash
    join; the longer chains prune the pairs of a bucket before the full Hamming distance.

    A bucket of more than ``small_bucket`` fingerprints is not compared pair by pair: each
    member goes to itself and to every point one bit away (outside the key), and those that
    meet at a point are linked to the smallest of them. Two fingerprints two bits apart
    always meet, and those that meet are never farther apart, so the links have the same
    components as all pairs. This path needs ``distance`` 2; for others give a
    ``small_bucket`` of None, which compares all pairs.
    """
    if small_bucket is not None and distance != 2:
        raise ValueError("the path for large buckets is for a distance of 2")
    widths = part_widths(parts)
    starts = [sum(widths[:i]) for i in range(parts)]
    agreeing = sum(1 for b in budgets(parts, distance) if b == 0)
    if not agreeing:
        raise ValueError("take more parts than twice the distance")
    masks = []
    for first in range(parts):
        ring = [(first + j) % parts for j in range(agreeing)]
        masks.append(sum(((1 << widths[i]) - 1) << starts[i] for i in ring))
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.explode(F.array(*(
        F.struct(F.lit(i).alias("first"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
        for i, m in enumerate(signed)))).alias("k")
    entries = work.keep(prints.select("fp").distinct().select("fp", keys)
                        .select("fp", "k.first", "k.key"), "entries")
    shared = entries.groupBy("first", "key").agg(F.count("*").alias("n")).where("n > 1")
    entries = work.keep(entries.join(shared, ["first", "key"]), "shared")

    small = entries if small_bucket is None else entries.where(F.col("n") <= small_bucket)
    left = small.select("first", "key", F.col("fp").alias("a"))
    right = small.select("first", "key", F.col("fp").alias("b"))
    holds = F.lit(False)
    for first in range(parts):
        holds = holds | ((F.col("first") == first)
                         & _chain_holds(F.col("a"), F.col("b"), first, parts, distance))
    pairs = (left.join(right, ["first", "key"]).where(F.col("a") < F.col("b")).where(holds)
             .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b"))
    if small_bucket is None:
        return pairs
    large = entries.where(F.col("n") > small_bucket)
    flips = F.array(F.lit(0).cast("long"), *(
        F.lit((1 << b) - (1 << 64) if b == 63 else 1 << b).cast("long") for b in range(BITS)))
    points = (large.select("first", "key", "fp", F.explode(flips).alias("flip"))
              .where(~F.array(*(F.lit(m).cast("long") for m in signed))[F.col("first")]
                     .bitwiseAND(F.col("flip")).cast("boolean"))
              .select("first", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point")))
    # A point has at most 65 fingerprints within one bit, so no group here is large.
    nearest = points.groupBy("first", "point").agg(F.collect_list("fp").alias("fps"))
    star = (nearest.where(F.size("fps") > 1)
            .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
            .where(F.col("a") != F.col("b")))
    return pairs.unionByName(star)


def simhash_components(docs: DataFrame, work: Workspace | None = None,
                       distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs`` (``doc_id, text, ...``).

    Rows with equal fingerprints count as one node. ``component_id`` is the smallest
    ``doc_id`` reachable over links of at most ``distance`` differing bits.

    Null and empty texts have fingerprint zero and are linked like any other. A null ``doc_id``
    keeps its row and never names a component (its component is null if all ids in it are).
    Repeated rows stay. An empty table gives an empty result. Other columns are not read.
    """
    work = work or Workspace(docs.sparkSession, "simhash")
    prints = work.keep(fingerprints(docs), "prints")
    classes = work.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("smallest")), "classes")
    roots = components(near_links(classes, work, distance), work)
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "smallest", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
    found = work.keep(rooted.join(named, "root").select("fp", "component_id"), "components")
    return prints.join(found, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, work: Workspace | None = None,
                         distance: int = DISTANCE) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates; same columns.

    The row with the smallest ``doc_id`` stays (null ids come last; ties: any one of the rows with
    the smallest text number). Documents without words have fingerprint zero and are one group.
    """
    work = work or Workspace(docs.sparkSession, "distinct")
    content = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("__content")
    prints = work.keep(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), content)
                       .mapInArrow(_fingerprints, "doc_id long, fp long, __content long"), "prints")
    classes = work.keep(prints.select("fp").distinct(), "classes")
    roots = components(near_links(classes, work, distance), work)
    # A row's place: ids before null ids, then the text's number.
    place = F.struct(F.col("doc_id").isNull().alias("__none"),
                     F.coalesce("doc_id", F.lit(0)).alias("__id"), "__content")
    firsts = prints.groupBy("fp").agg(F.min(place).alias("first"))
    kept = (firsts.join(roots, F.col("fp") == F.col("node"), "left")
            .groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
            .select("first.*").distinct())
    kept = work.keep(kept, "kept")
    there, back = carried(docs)
    rows = docs.select(*there, F.col("doc_id").isNull().alias("__none"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("__id"), content)
    keys = ["__none", "__id", "__content"]
    # Only rows that repeat both id and text meet each other to leave one of them.
    repeated = work.keep(rows.groupBy(*keys).count().where("count > 1").select(*keys), "repeated")
    if kept.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        kept = F.broadcast(kept)
    chosen = rows.join(kept, keys, "left_semi")
    if repeated.isEmpty():
        return chosen.select(*back)
    once = chosen.join(repeated, keys, "left_anti")
    return once.unionByName(chosen.join(repeated, keys, "left_semi").dropDuplicates(keys)).select(*back)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at two or fewer differing bits."""
    return simhash_components(table(spark, sf_dir, "documents"))
