"""The training-data queries against SQL where there is some, and on whole tables."""

from __future__ import annotations

import pytest

from vellum.llm import queries

from ..conftest import DATA
from ..oracle import rows_of_spark, rows_of_sql

SQL = queries.oracle_sql()
FOUND = {
    "p1_found": ["tab", "keep_id", "dup_id"], "p2_found": ["source", "verdict"], "p3_found": ["rec_id", "group_id"], "p5_found": ["group_id", "field", "val"],
    "p6_found": ["tab", "row_key"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert rows_of_spark(queries.queries()[name](spark, str(DATA))) == rows_of_sql(SQL[name], str(DATA))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs_and_has_its_columns(spark, name):
    df = queries.queries()[name](spark, str(DATA))
    assert name not in FOUND or df.columns == FOUND[name]
    rows = [tuple(map(str, r)) for r in df.collect()]
    if name in FOUND:
        assert len(rows) == len(set(rows))
