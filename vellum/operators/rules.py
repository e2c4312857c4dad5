"""Integrity rules: each a DataFrame ``(severity, check, subject)`` with one row per finding.

Rules are lazy and independent; an audit is their union, so tables shared by rules are scanned once where Spark can reuse
the exchange.  Every lookup is an equi-join (semi, anti or left); no rule compares rows pairwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import vocab
from ..functions.identity import author_key
from ..functions.text import numbers_in, numbers_missing, present

RULES: dict[str, Callable[..., DataFrame]] = {}
ERROR, WARN = "error", "warn"


def rule(check: str, severity: str | Column):
    """Register a function of the ledger that returns rows with a ``subject`` (and perhaps a ``severity``)."""

    def add(f: Callable[..., DataFrame]):
        def run(t, mode: str = "standard") -> DataFrame:
            rows = f(t, mode)
            level = F.col("severity") if "severity" in rows.columns else F.lit(severity)
            return rows.select(level.alias("severity"), F.lit(check).alias("check"), F.col("subject").cast("string").alias("subject"))

        RULES[check] = run
        return f

    return add


def _on(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*[F.col(old).alias(new) for new, old in names.items()])


@rule("claim-without-evidence", ERROR)
def _(t, mode):
    return t.claims.filter(F.size("evidence") == 0).select(F.col("id").alias("subject"))


@rule("claim-on-weak-evidence", WARN)
def _(t, mode):
    return t.cited.filter(F.col("score") < vocab.CITE_SCORE).select(F.col("claim").alias("subject")).distinct()


@rule("overstated-consensus", ERROR)
def _(t, mode):
    n = t.cited.groupBy("claim").agg(F.countDistinct("source").alias("n"))
    rows = t.claims.join(n.withColumnRenamed("claim", "id"), "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    strong = F.col("consensus") == "strong"
    return rows.filter(strong & (F.col("n") < 3) | ~strong & (F.col("n") == 1) & ~F.col("consensus").isin("thin", "absent")).select(F.col("id").alias("subject"))


@rule("possible-shared-authorship", WARN)
def _(t, mode):
    rows = t.cited.filter(F.col("consensus").isin("strong", "moderate")).select("claim", "source").distinct()
    keys = t.sources.select(F.col("id").alias("source"), F.explode("authors").alias("a")).select("source", author_key(F.col("a")).alias("author")).filter("author is not null").distinct()
    return rows.join(keys, "source").groupBy("claim", "author").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select(F.col("claim").alias("subject")).distinct()


@rule("single-venue-consensus", WARN)
def _(t, mode):
    rows = t.cited.filter(F.col("consensus").isin("strong", "moderate")).select("claim", "source").distinct()
    venue = t.sources.select(F.col("id").alias("source"), "rec_id").join(t.recs.select("rec_id", "venue"), "rec_id").filter(present(F.col("venue")))
    g = rows.join(venue.select("source", "venue"), "source").groupBy("claim").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("venue").alias("v"))
    return g.filter("n >= 3 and v = 1").select(F.col("claim").alias("subject"))


@rule("cited-but-unread", ERROR)
def _(t, mode):
    return t.cited.join(t.sources.filter("read_at is null").select(F.col("id").alias("source")), "source").select(F.concat_ws(">", "claim", "eid", "source").alias("subject"))


@rule("cited-but-not-included", WARN)
def _(t, mode):
    known = t.cited.join(_on(t.sources, source="id"), "source", "left_semi")
    return known.join(_on(t.included, source="id"), "source", "left_anti").select(F.concat_ws(">", "claim", "eid", "source").alias("subject"))


@rule("orphan-evidence", ERROR)
def _(t, mode):
    return t.ev.join(_on(t.sources, source="id"), "source", "left_anti").select(F.col("id").alias("subject"))


@rule("evidence-without-quote", WARN)
def _(t, mode):
    return t.ev.filter(~F.coalesce(present(F.col("quote")), F.lit(False))).select(F.col("id").alias("subject"))


@rule("number-not-in-quote", ERROR)
def _(t, mode):
    rows = t.ev.filter(present(F.col("quote"))).select("id", F.explode(numbers_missing(F.col("summary"), F.col("quote"))).alias("n"))
    return rows.select(F.concat_ws(" ", "id", "n").alias("subject"))


@rule("no-locator", WARN)
def _(t, mode):
    return t.ev.filter((F.col("score") >= vocab.CITE_SCORE) & ~F.coalesce(present(F.col("locator")), F.lit(False))).select(F.col("id").alias("subject"))


@rule("no-scope-note", WARN)
def _(t, mode):
    return t.ev.filter((F.col("score") >= vocab.CITE_SCORE) & ~F.coalesce(present(F.col("scope_note")), F.lit(False))).select(F.col("id").alias("subject"))


@rule("figure-from-abstract", ERROR)
def _(t, mode):
    """``from_scope`` is the scope at insert; where it is missing the source's present scope stands in."""
    used = t.claims.select(F.explode("evidence").alias("id")).distinct()
    scope = t.sources.select(F.col("id").alias("source"), "read_scope")
    rows = t.ev.join(used, "id", "left_semi").join(scope, "source", "left")
    rows = rows.filter(F.coalesce("from_scope", F.when(F.col("read_scope") == "abstract", "abstract").otherwise("fulltext")) == "abstract")
    return rows.filter(F.size(numbers_in(F.col("summary"))) > 0).select(F.col("id").alias("subject"), F.lit(WARN if mode == "quick" else ERROR).alias("severity"))


@rule("suspect-metadata", WARN)
def _(t, mode):
    flagged = t.sources.join(t.recs.filter(F.size("anomalies") > 0).select("rec_id"), "rec_id", "left_semi")
    rows = flagged.join(t.included.withColumn("inc", F.lit(True)), "id", "left")
    return rows.select(F.col("id").alias("subject"), F.when(F.col("inc"), ERROR).otherwise(WARN).alias("severity"))


@rule("retracted-included", ERROR)
def _(t, mode):
    return t.sources.join(t.recs.filter("retracted").select("rec_id"), "rec_id", "left_semi").join(t.included, "id", "left_semi").select(F.col("id").alias("subject"))


@rule("included-but-unused", WARN)
def _(t, mode):
    return t.included.join(t.ev.select(F.col("source").alias("id")), "id", "left_anti").select(F.col("id").alias("subject"))


@rule("included-but-unfetched", ERROR)
def _(t, mode):
    return t.sources.filter(~F.coalesce(present(F.col("metadata_at")), F.lit(False))).join(t.included, "id", "left_semi").select(F.col("id").alias("subject"))


@rule("included-but-unread", ERROR)
def _(t, mode):
    return t.sources.filter("read_at is null").join(t.included, "id", "left_semi").select(F.col("id").alias("subject"))


@rule("cache-missing", ERROR)
def _(t, mode):
    read = t.sources.filter("read_at is not null and coalesce(cache_chars, 0) = 0")
    return read.join(t.included, "id", "left_semi").select(F.col("id").alias("subject"))


@rule("abstract-only-in-systematic", WARN)
def _(t, mode):
    rows = t.sources.filter("read_scope = 'abstract'").join(t.included, "id", "left_semi").select(F.col("id").alias("subject"))
    return rows.filter(F.lit(mode == "systematic"))


@rule("matrix-hole", WARN)
def _(t, mode):
    """Missing cells by counting, not by crossing sources with columns: one finding per source that lacks a column."""
    held = t.extraction.select(F.col("source").alias("id"), "column").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    columns = t.extraction.agg(F.countDistinct("column").alias("all"))
    rows = t.included.join(held, "id", "left").crossJoin(F.broadcast(columns))  # one row
    return rows.filter((F.col("all") > 0) & (F.coalesce("n", F.lit(0)) < F.col("all"))).select(F.col("id").alias("subject"))


@rule("cell-without-quote", WARN)
def _(t, mode):
    exempt = F.col("value").rlike("(?i)^(not reported|n/a|none)$") | F.col("value").startswith("inferred:")
    return t.extraction.filter(~F.coalesce(present(F.col("quote")), F.lit(False)) & ~F.coalesce(exempt, F.lit(False))).select(F.concat_ws(".", "source", "column", F.col("seq").cast("string")).alias("subject"))


@rule("orphan-contradiction", ERROR)
def _(t, mode):
    return t.contradictions.select(F.explode(F.array("a", "b")).alias("id")).join(t.ev.select("id"), "id", "left_anti").select(F.col("id").alias("subject"))


@rule("question-thin", WARN)
def _(t, mode):
    return t.ev.groupBy("question").agg(F.max("score").alias("best")).filter(F.col("best") < vocab.CITE_SCORE).select(F.col("question").alias("subject"))


@rule("no-search-log", WARN)
def _(t, mode):
    return t.queries.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit("queries").alias("subject"))


@rule("orphan-verification", ERROR)
def _(t, mode):
    a = t.verification.join(_on(t.claims, claim="id"), "claim", "left_anti").select(F.concat_ws(">", "id", "claim").alias("subject"))
    b = t.verification.select("id", F.explode("evidence").alias("eid")).join(_on(t.ev, eid="id"), "eid", "left_anti").select(F.concat_ws(">", "id", "eid").alias("subject"))
    return a.unionByName(b)


@rule("claim-failed-verification", ERROR)
def _(t, mode):
    return t.verification.filter("status = 'unsupported'").select(F.concat_ws(">", "claim", "id").alias("subject"))


@rule("contradiction-not-recorded", ERROR)
def _(t, mode):
    """Covered if either side of any contradiction is among the evidence: the OR is a union of keys."""
    sides = t.contradictions.select(F.explode(F.array("a", "b")).alias("eid")).distinct()
    bad = t.verification.filter("status = 'contradicted'")
    covered = bad.select("id", F.explode("evidence").alias("eid")).join(sides, "eid", "left_semi").select("id").distinct()
    return bad.join(covered, "id", "left_anti").select(F.concat_ws(">", "claim", "id").alias("subject"))


@rule("claim-unverified", WARN)
def _(t, mode):
    some = t.verification.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit(1).alias("any"))
    rows = t.claims.join(t.verification.select(F.col("claim").alias("id")), "id", "left_anti")
    return rows.crossJoin(F.broadcast(some)).select(F.col("id").alias("subject"))  # at most one row


@rule("access-bias-unobtainable", WARN)
def _(t, mode):
    p = t.latest.filter("reviewer = 'pass1'").agg(F.count(F.lit(1)).alias("screened"), F.count_if(F.expr("verdict = 'exclude' and reason = 'unobtainable'")).alias("n"))
    return p.filter("n >= 3 and n / screened >= 0.15").select(F.lit("unobtainable").alias("subject"))


@rule("access-bias-abstract-only", WARN)
def _(t, mode):
    p = t.sources.join(t.included, "id", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("read_scope = 'abstract'")).alias("a"))
    return p.filter("n >= 2 and a / n >= 0.5").select(F.lit("abstract-only").alias("subject"))


def audit(t, mode: str = "standard") -> DataFrame:
    """All findings."""
    out = None
    for run in RULES.values():
        out = run(t, mode) if out is None else out.unionByName(run(t, mode))
    return out


def summary(findings: DataFrame, first: int = 20) -> DataFrame:
    """``(severity, check, findings, subjects)``: how many there are of each kind, and the first of their subjects (a top-k report)."""
    n = findings.groupBy("severity", "check").agg(F.count(F.lit(1)).alias("findings"))
    w = W.partitionBy("severity", "check").orderBy("subject")
    top = findings.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= first)
    listed = top.groupBy("severity", "check").agg(F.array_join(F.array_sort(F.collect_list("subject")), "; ").alias("subjects"))
    return n.join(listed, ["severity", "check"])
