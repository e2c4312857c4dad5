"""Chunks of full texts."""

from __future__ import annotations

from vellum.plans import texts

from .conftest import values
from .oracle import rows_of_spark, rows_of_sql


def test_no_text_of_a_full_text_is_lost(spark, make, tmp_path):
    bodies = {1: "Before.\n\n## Abstract\nA.\n\n## Results\nR 1.\nR 2.", 2: "No heading at all.", 3: "# Methods\nM.\n### Sample\nS.", 4: None}
    make("documents", *[{"doc_id": k, "doc_kind": "fulltext", "text": v} for k, v in bodies.items()], {"doc_id": 5, "doc_kind": "report", "text": "x"}).write.parquet(str(tmp_path / "documents.parquet"))
    got = texts.QUERIES["chunk_texts"](spark, str(tmp_path))
    assert values(got, "doc_id", "place", "heading", "rank", "text") == [
        (1, 0, "", 6, "Before.\n"), (1, 1, "Abstract", 7, "A.\n"), (1, 2, "Results", 1, "R 1.\nR 2."), (2, 0, "", 6, "No heading at all."), (3, 1, "Methods", 2, "M."), (3, 2, "Sample", 6, "S."),
    ]
    assert rows_of_spark(got) == rows_of_sql(texts.ORACLES["chunk_texts"], str(tmp_path))
