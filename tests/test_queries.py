"""Every query that has SQL gives the same rows as it."""

from __future__ import annotations

import os

import pytest

from tabulith import oracle, queries, queries_metadata, queries_tables
from tests.compare import compare

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ALL = queries.queries() | queries_tables.queries() | queries_metadata.queries()
SQL = oracle.sql()


def test_names_match():
    assert set(SQL) <= set(ALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    assert compare(spark, FOLDER, ALL[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs(spark, name):
    df = ALL[name](spark, FOLDER)
    assert df.columns and df.count() >= 0
