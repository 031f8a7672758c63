"""Queries with SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect
from lexloom.llm import registered


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query(spark, sf_dir, name):
    good, note = compare(spark, connect(sf_dir), name, sf_dir, entry.queries()[name],
                         entry.oracle_sql()[name])
    assert good, note


def test_one_query_for_each_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registered.queries())
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()
