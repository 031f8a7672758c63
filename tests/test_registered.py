"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as registered
from checks import oracles, queries
from checks.compare import compare, connect


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


def test_names_match():
    assert set(registered.oracle_sql()) <= set(registered.queries())
    assert set(oracles.oracle_sql()) == set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, sf_dir, connection, name):
    good, note = compare(spark, connection, name, sf_dir, registered.queries()[name],
                         registered.oracle_sql()[name])
    assert good, note


def test_entry(spark):
    rows = registered.entry(spark).collect()
    assert 0 < len(rows) <= 100
    assert all(r.pos == "NOUN" and r.len >= 6 for r in rows)
