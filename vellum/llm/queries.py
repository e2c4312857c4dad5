"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import components, consensus, formatting_dups, leakage, packing, sql, stuffing, survivor, truncation


def _with(f: Callable[..., DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: f(*(table(spark, folder, n) for n in names))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": _with(formatting_dups.found, "recs", "rec_lines"),
        "p1_records": _with(formatting_dups.one_each, "recs", "rec_lines"),
        "p2_found": _with(consensus.found, "screening"),
        "p2_agreement": _with(consensus.agreement, "screening"),
        "p2_reviewers": _with(consensus.reliability, "screening"),
        "p3_found": _with(components.groups, "recs"),
        "p5_found": _with(survivor.found, "recs"),
        "p5_fields": _with(survivor.fields, "recs"),
        "p5_survivors": _with(survivor.survivors, "recs"),
        "p6_found": _with(truncation.found, "recs", "evidence", "sources"),
        "p6_shares": _with(truncation.shares, "recs", "evidence", "sources"),
        "p7_containers": _with(packing.containers, "documents"),
        "p7_unused": _with(packing.unused, "documents"),
        "p8_found": _with(leakage.found, "documents", "eval_items"),
        "p8_items": _with(leakage.leaked_items, "documents", "eval_items"),
        "p9_found": _with(stuffing.found, "documents"),
    }


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
