"""Every core query with SQL against that SQL, on the smallest tables."""

from __future__ import annotations

import __spark_entry__ as entry
import pytest

from .conftest import DATA
from .oracle import rows_of_spark, rows_of_sql

CORE = {k: v for part in entry.PARTS for k, v in part.QUERIES.items()}
SQL = {k: v for part in entry.PARTS for k, v in part.ORACLES.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert rows_of_spark(CORE[name](spark, str(DATA))) == rows_of_sql(SQL[name], str(DATA))


def test_every_query_has_sql():
    assert set(CORE) == set(SQL)


def test_entry_gives_findings(spark):
    df = entry.entry(spark)
    assert df.columns == ["severity", "check", "subject"] and df.count() > 0


def test_no_core_module_imports_the_training_data_package():
    from pathlib import Path

    root = Path(entry.__file__).parent / "vellum"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert ".llm" not in p.read_text().replace("``vellum.llm``", ""), p
