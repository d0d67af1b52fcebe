from __future__ import annotations

import pytest

from tabulith.llm import queries

COLUMNS = {"p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_runs(spark, name):
    df = queries.queries()[name](spark, "/root/testdata/sf0.001")
    assert df.columns == COLUMNS.get(name, df.columns) and df.count() > 0 and df.distinct().count() == df.count()


def test_all_posts_are_packed(spark):
    df = queries.queries()["p7_containers"](spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert df.select("doc_id").distinct().count() == docs.count()
    assert df.where("place + n_tokens > 2048").count() == 0
