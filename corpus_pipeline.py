"""From raw documents to a training mix: each stage reads what the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexloom.llm import decontaminate, mixing, passages, quality, simhash
from lexloom.llm.sample import labelled_sample
from lexloom.llm.store import Workspace, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the documents that the quality classifier rejects."""
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "quality",
                             quality.learnable(F.col("doc_id")))
    return quality.keep_good(docs, quality.train(sample))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of SimHash near-duplicates."""
    return simhash.drop_near_duplicates(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has; drops documents of which nothing is left."""
    return passages.drop_repeated_passages(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold a benchmark item, also with other numbers or names."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and cuts sources to their target weights; adds ``epoch`` and ``tokens_taken``."""
    return mixing.mix_sources(docs, mixing.document_levels(), mixing.BUDGET_SHARE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("passages", passage_stage),
    ("benchmark", benchmark_stage),
    ("mixing", mixing_stage),
]

#: A trained network, XXH64 fingerprints and verified passages are beyond DuckDB's SQL;
#: tests/llm/test_pipeline.py holds the stages against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as a table and read again by the next."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.keep(stage(spark, docs, sf_dir), name)
    return docs
