"""Memory compaction on files with near copies."""

from __future__ import annotations

from vellum.plans import texts
from vellum.plans.views import Ledger

from .conftest import values
from .oracle import rows_of_spark, rows_of_sql


def test_near_copies_fold_within_a_file_and_the_band_is_counted(spark, make, tmp_path):
    ten = "alpha bravo charlie delta echo foxtrot golf hotel india juliet"
    file = "\n".join([
        "## scope", f"- [2024-03-02] {ten} {{tags: b, a}}", "## method", f"- [2024-01-05] {ten} kilo {{tags: c}}", f"- [2024-02-01] {ten} kilo lima",
        "- [2024-04-01] alpha bravo charlie delta echo foxtrot golf", "- [2024-05-01] the of and",
    ])
    make("documents", {"doc_id": 1, "doc_kind": "memory", "text": file}, {"doc_id": 2, "doc_kind": "memory", "text": f"- [2023-01-01] {ten}"}).write.parquet(str(tmp_path / "documents.parquet"))
    got = texts.QUERIES["memory_fold_similar"](spark, str(tmp_path))
    whole = (1, 3, f"{ten} kilo lima", "2024-01-05", "a,b,c")
    assert values(got, "doc_id", "line", "fold_line", "entries", "kept", "since", "all_tags", "near") == sorted(
        [(1, 1, *whole, 1), (1, 3, *whole, 1), (1, 4, *whole, 1), (1, 5, 5, 1, "alpha bravo charlie delta echo foxtrot golf", "2024-04-01", "", 3), (1, 6, 6, 1, "the of and", "2024-05-01", "", 0), (2, 0, 0, 1, ten, "2023-01-01", "", 0)], key=repr
    )
    assert rows_of_spark(got) == rows_of_sql(texts.ORACLES["memory_fold_similar"], str(tmp_path))
