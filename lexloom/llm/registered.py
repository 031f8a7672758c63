"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import (chat, codes, decontaminate, fixity, mixing, oracles, passages, periods,
                         quality, secrets, simhash, tokencount, topk, toxicity)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query for each operator."""
    return {
        "op1_token_counts": tokencount.op1_token_counts,
        "op2_repeated_passages": passages.op2_repeated_passages,
        "op3_mixing": mixing.op3_mixing,
        "op4_topk": topk.op4_topk,
        "op5_chat_format": chat.op5_chat_format,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_quality": quality.op7_quality,
        "op8_warc_fixity": fixity.op8_warc_fixity,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_simhash": simhash.op10_simhash,
        "op11_vector_codes": codes.op11_vector_codes,
        "op12_secrets": secrets.op12_secrets,
        "op13_periods": periods.op13_periods,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return oracles.oracle_sql()
