from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from vellum.session import local_session

    session = local_session(cores=8, partitions=4, memory="4g", name="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Rows of one of the given tables: columns that a row leaves out are null."""
    schemas = {}

    def build(table: str, *rows: dict):
        if table not in schemas:
            schemas[table] = spark.read.parquet(str(DATA / f"{table}.parquet")).schema
        schema = schemas[table]
        return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)

    return build


def values(df, *columns):
    """The rows as a sorted list of tuples."""
    return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=repr)
