"""All text queries on empty tables and on tables full of NULLs."""

from __future__ import annotations

import pytest

from tabulith.llm import queries
from tests import dirt

SOURCE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return dirt.empty(spark, tmp_path_factory.mktemp("empty"), SOURCE)


@pytest.fixture(scope="module")
def nulled(spark, tmp_path_factory):
    return dirt.nulled(spark, tmp_path_factory.mktemp("nulled"), SOURCE)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty(spark, empty, name):
    assert queries.queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_nulls(spark, nulled, name):
    rows = queries.queries()[name](spark, nulled).collect()
    if name.endswith("_found"):
        assert len(rows) == len({tuple(r) for r in rows})
