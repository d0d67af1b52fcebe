"""All problem queries of the core on empty tables and on tables full of NULLs."""

from __future__ import annotations

import pytest

from tabulith import oracle, queries
from tests import dirt
from tests.compare import compare

SOURCE = "/root/testdata/sf0.001"
NAMES = [n for n in queries.queries() if n.startswith("p")]
# what the SQL leaves open: which of rows that tie is in force, and rows without keys
COMPARED = ("p5_found", "p5_summaries")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return dirt.empty(spark, tmp_path_factory.mktemp("empty"), SOURCE)


@pytest.fixture(scope="module")
def nulled(spark, tmp_path_factory):
    return dirt.nulled(spark, tmp_path_factory.mktemp("nulled"), SOURCE)


@pytest.mark.parametrize("name", NAMES)
def test_empty(spark, empty, name):
    assert queries.queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_nulls(spark, nulled, name):
    df = queries.queries()[name](spark, nulled)
    rows = df.collect()
    if name.endswith("_found"):
        assert len(rows) == len({tuple(r) for r in rows})


@pytest.mark.parametrize("name", COMPARED)
def test_nulls_as_sql(spark, nulled, name):
    query = queries.queries()[name]
    assert compare(spark, nulled.removeprefix("file://"), lambda s, d: query(s, f"file://{d}"), oracle.sql()[name]) == ""
