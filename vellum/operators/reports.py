"""Reports and memory files as text: prose, paragraphs, sections, citations and entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import vocab
from ..functions.text import has_figure, normalised, prose, similarity, tokens

FIGURE_EXEMPT = r"^[#|>]"


def citations(reports: DataFrame) -> DataFrame:
    """``(doc_id, cited)``: the ids each report's prose cites, once each."""
    ids = F.array_distinct(F.regexp_extract_all(prose(F.col("text")), F.lit(vocab.CITATION), F.lit(1)))
    return reports.select("doc_id", F.explode(ids).alias("cited"))


def paragraphs(reports: DataFrame) -> DataFrame:
    """``(doc_id, place, paragraph)`` of the prose."""
    parts = reports.select("doc_id", F.posexplode(F.split(prose(F.col("text")), r"\n\s*\n")).alias("place", "p"))
    return parts.select("doc_id", F.col("place").cast("bigint").alias("place"), F.regexp_replace("p", r"^\s+|\s+$", "").alias("paragraph")).filter("paragraph <> ''")


def bare_figures(reports: DataFrame) -> DataFrame:
    """``(doc_id, place)`` of paragraphs that state a figure and cite nothing; headings, tables and quotes are exempt."""
    p = F.col("paragraph")
    return paragraphs(reports).filter(~p.rlike(FIGURE_EXEMPT) & has_figure(p) & ~p.rlike(vocab.CITATION)).select("doc_id", "place")


def sections(reports: DataFrame) -> DataFrame:
    """``(doc_id, place, heading, body)`` of the prose, one row per ``##`` heading."""
    parts = reports.select("doc_id", F.posexplode(F.split(prose(F.col("text")), r"(?m)^(?=##\s)")).alias("place", "s"))
    heading = F.regexp_extract("s", r"^##\s+([^\n]+)", 1)
    body = F.regexp_replace(F.regexp_replace("s", r"^##\s+[^\n]+", ""), r"^\s+|\s+$", "")
    return parts.select("doc_id", "place", F.trim(heading).alias("heading"), body.alias("body")).filter("heading <> ''")


def memory_entries(files: DataFrame) -> DataFrame:
    """``(doc_id, line, kind, date, text, tags)`` of memory files: ``## kind`` headings carry forward, other lines are skipped.

    The window runs within one file; a file's lines are bounded by its length.
    """
    lines = files.select("doc_id", F.posexplode(F.split("text", "\r?\n")).alias("line", "s"))
    head = F.when(F.col("s").rlike(r"^##\s+\w+\s*$"), F.regexp_extract("s", r"^##\s+(\w+)", 1))
    kept = lines.withColumn("kind", F.last(head, ignorenulls=True).over(W.partitionBy("doc_id").orderBy("line").rowsBetween(W.unboundedPreceding, 0)))
    entry = r"^\s*-\s*\[(\d{4}-\d{2}-\d{2})\]\s*(.*?)(?:\s*\{tags:\s*([^}]*)\})?\s*$"
    rows = kept.filter(F.col("s").rlike(r"^\s*-\s*\[\d{4}-\d{2}-\d{2}\]")).select("doc_id", F.col("line").cast("bigint").alias("line"), F.coalesce("kind", F.lit("preference")).alias("kind"), *[F.regexp_extract("s", entry, i).alias(c) for i, c in ((1, "date"), (2, "text"), (3, "tags"))])
    return rows.filter("text <> ''")


def capped(entries: DataFrame, per_kind: int = vocab.MEMORY_PER_KIND, total: int = vocab.MEMORY_TOTAL, owner: str = "doc_id") -> DataFrame:
    """The newest entries of each kind, then the newest of all, within each owner."""
    w = W.partitionBy(owner, "kind").orderBy(F.desc("date"), "line")
    some = entries.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= per_kind)
    w = W.partitionBy(owner).orderBy(F.desc("date"), "line")
    return some.withColumn("place", F.row_number().over(w).cast("bigint")).filter(F.col("place") <= total).drop("rk")


#: How a report's block of counts begins and ends; its payload is a JSON object between the opening mark and the next comment end.
COUNTS_OPEN, COUNTS_CLOSE = "<!-- counts v1", "<!-- /counts -->"


def counts_block(payload: Column) -> Column:
    """The block that a report carries, around a JSON object of counts."""
    return F.concat(F.lit(COUNTS_OPEN + "\n"), payload, F.lit("\n-->\n" + COUNTS_CLOSE))


def counts_findings(reports: DataFrame, truth: DataFrame, opens: str = COUNTS_OPEN, closes: str = COUNTS_CLOSE) -> DataFrame:
    """``(severity, check, subject)`` of each report's block of counts against ``truth (key, n)``; only the keys it declares are compared.

    A report without a block, a block without its end mark, a payload that is no JSON object, a key that isn't known, a count that differs.  Only the first block
    counts; null texts have none.  A declared value that is no number differs from any count.
    """
    text = F.coalesce("text", F.lit(""))
    at = F.locate(opens, text)
    after = F.expr("substring(t, a)")
    rows = reports.select("doc_id", text.alias("t"), at.alias("a"))
    rows = rows.select("doc_id", "a", after.alias("rest"))
    payload = F.trim(F.regexp_replace(F.substring_index(F.expr(f"substring(rest, {len(opens) + 1})"), "-->", 1), r"^\s+|\s+$", ""))
    fields = F.expr("try_cast(try_parse_json(payload) as map<string,string>)")
    rows = rows.select("doc_id", "a", (F.locate(closes, F.col("rest")) > 0).alias("closed"), payload.alias("payload")).withColumn("declared", F.when(F.col("a") > 0, fields))
    finding = lambda df, severity, check, subject: df.select(F.lit(severity).alias("severity"), F.lit(check).alias("check"), subject.alias("subject"))
    doc = F.col("doc_id").cast("string")
    out = finding(rows.filter("a = 0"), "warn", "no-stats-block", doc)
    out = out.unionByName(finding(rows.filter("a > 0 and not closed"), "error", "stats-block-unterminated", doc))
    out = out.unionByName(finding(rows.filter("a > 0 and declared is null"), "error", "stats-block-unparseable", doc))
    each = rows.select("doc_id", F.explode("declared").alias("key", "value")).join(truth.select("key", "n"), "key", "left")
    named = F.concat_ws(">", doc, "key")
    out = out.unionByName(finding(each.filter("n is null"), "warn", "stats-block-unknown-key", named))
    return out.unionByName(finding(each.filter("n is not null and not coalesce(try_cast(value as double) = n, false)"), "error", "stats-block-stale", named))


def memory_edits(entries: DataFrame, edits: DataFrame) -> DataFrame:
    """``(doc_id, op, hits, outcome, entries, changed)``: what an edit does to its memory file; ``edits (doc_id, op, target, text, every)``, one per file.

    ``replace`` changes the one entry that holds the target, whatever its case, or equals it to 0.8 or more in words; ``forget`` removes the one that holds it, or all
    with ``every``.  Outcomes: ``no-target`` (or, to replace, no new text), ``no-match``, ``ambiguous`` (several, nothing is done), ``done``.  ``entries`` are
    those left, ``changed`` the line replaced, null else.  A file without entries matches nothing; an edit of null kind is left out.
    """
    target, text = normalised(F.coalesce("target", F.lit(""))), normalised(F.coalesce("text", F.lit("")))
    edits = edits.filter(F.col("op").isin("replace", "forget")).select("doc_id", "op", target.alias("target"), text.alias("new"), F.coalesce("every", F.lit(False)).alias("every"))
    rows = edits.join(entries.select("doc_id", "line", "text"), "doc_id", "left")
    holds = F.contains(F.lower("text"), F.lower("target")) & (F.col("target") != "")
    alike = (F.col("op") == "replace") & (similarity(tokens(F.col("text")), tokens(F.col("target"))) >= vocab.SAME_ENTRY)
    hit = F.coalesce((holds | alike) & F.col("line").isNotNull(), F.lit(False))
    g = rows.withColumn("hit", hit).groupBy("doc_id", "op", "target", "new", "every").agg(F.count_if("hit").alias("hits"), F.count("line").alias("n"), F.min(F.when(F.col("hit"), F.col("line"))).alias("line"))
    replace = F.col("op") == "replace"
    outcome = F.when((F.col("target") == "") | replace & (F.col("new") == ""), "no-target").when(F.col("hits") == 0, "no-match").when((F.col("hits") > 1) & ~(~replace & F.col("every")), "ambiguous").otherwise("done")
    g = g.withColumn("outcome", outcome)
    done = F.col("outcome") == "done"
    return g.select("doc_id", "op", "hits", "outcome", (F.col("n") - F.when(done & ~replace, F.col("hits")).otherwise(0)).alias("entries"), F.when(done & replace, F.col("line")).alias("changed"))
