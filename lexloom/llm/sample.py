"""Bounded, labelled training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Rows of each class that a model is trained on, at most.
SAMPLE_ROWS = 2000
#: Longer texts are left out of the sample (never out of the scoring).
SAMPLE_BYTES = 32_768


def remainder(doc_id: Column, parts: int) -> Column:
    """CRC-32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column,
                    rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``text, label``: up to ``rows`` texts of each class, chosen by a hash of the id.

    ``allowed`` is a condition on ``doc_id`` for rows that may be learned from. Labels other
    than 0 and 1, null texts and ids, and texts above ``most_bytes`` are not used. Repeated
    texts are used once. The ids are cut by two small sorts before any text moves.
    """
    usable = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).where(allowed)
    # One text in several rows, or under several ids, would count twice: ask for spare ids.
    chosen = None
    for value in (0, 1):
        part = (usable.where(F.col("label") == value).distinct()
                .orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * rows))
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(
        F.octet_length("text") <= most_bytes)
    # At most 4 x rows ids, so the broadcast is bounded.
    found = (texts.join(F.broadcast(chosen), "doc_id").select("text", "label")
             .groupBy(F.sha2("text", 256).alias("digest"), "label").agg(F.first("text").alias("text")))
    parts = [found.where(F.col("label") == v).orderBy("digest").limit(rows) for v in (0, 1)]
    return parts[0].unionByName(parts[1]).select("text", "label")
