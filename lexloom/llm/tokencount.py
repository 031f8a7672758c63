"""Token counts through a cache of content digests."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexloom.llm.store import Workspace, table

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
LIMIT = 1024
#: A set of up to this many 32-byte digests is broadcast; more are shuffled.
BROADCAST_DIGESTS = 500_000
#: Units whose counts a Python worker remembers before it starts anew.
REMEMBERED = 1_000_000
#: Characters encoded in one call.
_CALL_CHARS = 1 << 18

# Where a byte-level tokenizer with its standard pattern surely ends one piece and starts the
# next: before a single blank or line break between two other characters, and between a letter
# and a mark. No piece reaches over such a place, and the marks occur in no special token.
_UNIT = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=[A-Za-zÀ-ÖØ-öø-ÿ])(?=[.,!?;:])")
_MARKS = frozenset(" \n.,!?;:")


def tokenizer_digest(path: str) -> str:
    """Digest of a tokenizer's file and of the library version that reads it."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as file:
        body = hashlib.sha256(file.read())
    body.update(f"{library.__name__} {library.__version__}".encode())
    return body.hexdigest()


class _Counter:
    """Counts tokens of texts, remembering units of byte-level tokenizers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.units: dict[str, int] = {}
        self.words: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: list(map(len, self.model.encode(texts, num_threads=1)))
            self.by_unit = False
            return
        import tokenizers

        self.model = tokenizers.Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.encode = lambda texts: list(map(len, self.model.encode_batch_fast(
            texts, add_special_tokens=False)))
        settings = json.loads(self.model.to_str())
        split = settings.get("pre_tokenizer") or {}
        added = settings.get("added_tokens") or []
        self.by_unit = (settings.get("normalizer") is None and split.get("type") == "ByteLevel"
                        and split.get("use_regex", True) and not split.get("add_prefix_space")
                        and not any(_MARKS & set(x["content"]) or x["lstrip"] or x["rstrip"]
                                    or x["single_word"] for x in added))

    def _learn(self, units: list[str]) -> None:
        missing = [u for u in dict.fromkeys(units) if u not in self.units]
        if len(self.units) + len(missing) > REMEMBERED:
            self.units, missing = {}, list(dict.fromkeys(units))
        start = 0
        while start < len(missing):
            stop, chars = start, 0
            while stop < len(missing) and chars < _CALL_CHARS:
                chars += len(missing[stop])
                stop += 1
            self.units.update(zip(missing[start:stop], self.encode(missing[start:stop])))
            start = stop

    def count(self, text: str) -> int:
        """Tokens of one text."""
        if not self.by_unit:
            return self.encode([text])[0] if text else 0
        if text.count(" ") + text.count("\n") + 1 != len(text.split()):
            # Runs of white space, or other kinds of it: cut only where that is safe.
            units = _UNIT.split(text)
            self._learn(units)
            return sum(map(self.units.__getitem__, units))
        # Single blanks and line breaks only. Words are looked up with what stands before them.
        words = text.replace("\n", " \n").split(" ")
        words[0] = "\0" + words[0]  # the only one without a blank or line break before it
        new = [w for w in dict.fromkeys(words) if w not in self.words]
        if new:
            if len(self.words) + len(new) > REMEMBERED:
                self.words, new = {}, list(dict.fromkeys(words))
            cut = [_UNIT.split(w[1:] if w[0] == "\0" else w if w[0] == "\n" else " " + w)
                   for w in new]
            self._learn([u for units in cut for u in units])
            for word, units in zip(new, cut):
                self.words[word] = sum(map(self.units.__getitem__, units))
        return sum(map(self.words.__getitem__, words))


_counters: dict[str, _Counter] = {}


def counter(path: str) -> _Counter:
    """The worker's counter for a tokenizer file; its memory outlives a task."""
    if path not in _counters:
        _counters[path] = _Counter(path)
    return _counters[path]


def _encoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([count(x.as_py()) for x in batch.column(1)], pa.int64())],
                names=["digest", "n_tokens"])

    return run


def no_null(text: Column) -> Column:
    """The normal form of a text for tokenizers that keep every character: null is empty."""
    return F.coalesce(text, F.lit(""))


def read_cache(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """``digest, n_tokens`` stored for a tokenizer; none if the cache does not exist yet."""
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    # Two runs at a time may both have appended a digest.
    return (stored.where(F.col("tokenizer") == tokenizer)
            .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str, work: Workspace | None = None,
                 limit: int = LIMIT, normalise: Callable[[Column], Column] = no_null) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs`` (``doc_id, text, ...``).

    A text's key is the SHA-256 of its normal form together with the digest of tokenizer file
    and library version. Keys found in ``cache`` (a Parquet table) are not encoded again. Of the
    others, each distinct text is encoded once and appended to the cache. ``normalise`` may
    only do what does not change the count. ``n_bytes`` is the UTF-8 length of the normal form.

    A null text counts as empty, an empty text has no tokens, null or repeated ids keep their
    rows, an empty table gives an empty result, and other columns are not read.
    """
    spark = docs.sparkSession
    work = work or Workspace(spark, "tokens")
    version = tokenizer_digest(tokenizer_path)
    texts = docs.select("doc_id", normalise(F.col("text").cast("string")).alias("text")).withColumn(
        "digest", F.unhex(F.sha2("text", 256)))
    keyed = work.keep(texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
                                   "digest"), "keys")
    misses = work.keep(keyed.select("digest").distinct().join(
        read_cache(spark, cache, version), "digest", "left_anti"), "misses")
    n_misses = misses.limit(BROADCAST_DIGESTS + 1).count()
    content = texts.select("digest", "text")
    if n_misses:
        if n_misses <= BROADCAST_DIGESTS:
            wanted = content.join(F.broadcast(misses), "digest", "left_semi").dropDuplicates(["digest"])
        else:
            # Copies are dropped before the shuffle, which the semi-join then shares.
            wanted = content.dropDuplicates(["digest"]).join(misses, "digest", "left_semi")
        (wanted.mapInArrow(_encoder(tokenizer_path), "digest binary, n_tokens long")
         .select(F.lit(version).alias("tokenizer"), "digest", "n_tokens")
         .write.mode("append").parquet(cache))
    # Written, so that both sides of the last join are plain and hot digests can be split.
    counts = work.keep(read_cache(spark, cache, version).join(
        keyed.select("digest").distinct(), "digest", "left_semi"), "counts")
    return keyed.join(counts, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, from an empty cache."""
    import public_tokenizers

    work = Workspace(spark, "tokens")
    return count_tokens(table(spark, sf_dir, "documents"),
                        public_tokenizers.path("byte_bpe_50k.json"), work.path("cache"), work)
