"""Findings of reports and graphs, in the form of the ledger's: ``(severity, check, subject)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import has_figure
from ..operators import reports
from ..sources.shared import Scratch
from . import texts
from .texts import _CITED, _E, _N, _PARAS, _PROSE, _REPORTS, _STATE, _reports
from .views import SQL, Ledger

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Ledger(spark, folder))
        ORACLES[f.__name__] = SQL + sql
        return f

    return add


_FIGURE = r"(regexp_matches(regexp_replace(paragraph, '\[((?:S|E|CL)\d+)\]', ' ', 'g'), '(^|[^\p{L}\d._-])\d+(?:[.,]\d+)?\s*%') OR regexp_matches(regexp_replace(regexp_replace(paragraph, '\[((?:S|E|CL)\d+)\]', ' ', 'g'), '\b(19|20)\d{2}\b', ' ', 'g'), '(^|[^\p{L}\d._-])\d{2,}($|[^\d\p{L}-])'))"
_ABSTRACT = rf"""SELECT doc_id, place FROM (SELECT DISTINCT doc_id, place, unnest(regexp_extract_all(paragraph, '\[(S\d+)\]', 1)) AS sid FROM {_PARAS} WHERE paragraph <> '' AND NOT regexp_matches(paragraph, '^[#|>]') AND {_FIGURE}) JOIN sources s ON s.id = sid GROUP BY 1, 2 HAVING count(*) = count(*) FILTER (read_scope = 'abstract')"""


@query(_ABSTRACT)
def report_figure_from_abstract(t: Ledger) -> DataFrame:
    """Paragraphs with a figure of which every known cited source was read as an abstract only."""
    p = F.col("paragraph")
    rows = reports.paragraphs(_reports(t)).filter(~p.rlike(reports.FIGURE_EXEMPT) & has_figure(p))
    ids = rows.select("doc_id", "place", F.explode(F.array_distinct(F.regexp_extract_all(p, F.lit(r"\[(S\d+)\]"), F.lit(1)))).alias("id"))
    g = ids.join(t.sources.select("id", "read_scope"), "id").groupBy("doc_id", "place").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("read_scope") == "abstract").alias("a"))
    return g.filter("n = a").select("doc_id", "place")


def _finding(rows: DataFrame, severity: str, check: str | Column, *subject: str) -> DataFrame:
    name = F.lit(check) if isinstance(check, str) else check
    return rows.select(F.lit(severity).alias("severity"), name.alias("check"), F.concat_ws(">", *[F.col(c).cast("string") for c in subject]).alias("subject"))


_SECTIONS = rf"SELECT doc_id, place FROM (SELECT doc_id, generate_subscripts(a, 1) AS place, unnest(a) AS s FROM (SELECT doc_id, regexp_split_to_array(chr(10) || {_PROSE}, '\n##\s+')[2:] AS a FROM {_REPORTS})) WHERE length(regexp_replace(regexp_replace(s, '^[^\n]+', ''), '^\s+|\s+$', '', 'g')) > 400 AND NOT regexp_matches(s, '\[((?:S|E|CL)\d+)\]')"
_BARE = rf"SELECT doc_id, place FROM {_PARAS} WHERE paragraph <> '' AND NOT regexp_matches(paragraph, '^[#|>]') AND NOT regexp_matches(paragraph, '\[((?:S|E|CL)\d+)\]') AND {_FIGURE}"


@query(f"""SELECT 'error' AS severity, 'report-uncited' AS "check", CAST(doc_id AS VARCHAR) AS subject FROM {_REPORTS} WHERE doc_id NOT IN (SELECT doc_id FROM {_CITED})
UNION ALL SELECT 'error', state, doc_id || '>' || cited FROM (SELECT doc_id, cited, {_STATE} AS state FROM {_CITED} LEFT JOIN sources s ON s.id = cited LEFT JOIN inc i ON i.id = cited LEFT JOIN ev e ON e.id = cited LEFT JOIN claims c ON c.id = cited) WHERE state <> 'ok'
UNION ALL SELECT 'error', 'figure-without-citation', doc_id || '>' || place FROM ({_BARE})
UNION ALL SELECT 'error', 'report-figure-from-abstract', doc_id || '>' || place FROM ({_ABSTRACT})
UNION ALL SELECT 'warn', 'section-without-citation', CAST(doc_id AS VARCHAR) FROM ({_SECTIONS})
UNION ALL SELECT 'error', 'no-currency-line', CAST(doc_id AS VARCHAR) FROM {_REPORTS} WHERE NOT regexp_matches(text, '(?i){vocab.AS_OF}')""")
def report_findings(t: Ledger) -> DataFrame:
    """All findings about reports: one row per report, citation, paragraph or section."""
    sections = reports.sections(_reports(t)).filter((F.length("body") > 400) & ~F.col("body").rlike(vocab.CITATION) & ~F.col("heading").rlike(vocab.CITATION))
    parts = [
        _finding(_reports(t).select("doc_id").join(reports.citations(_reports(t)), "doc_id", "left_anti"), "error", "report-uncited", "doc_id"),
        _finding(texts.citation_check(t).filter("state <> 'ok'"), "error", F.col("state"), "doc_id", "cited"),
        _finding(reports.bare_figures(_reports(t)), "error", "figure-without-citation", "doc_id", "place"),
        _finding(report_figure_from_abstract(t), "error", "report-figure-from-abstract", "doc_id", "place"),
        _finding(sections, "warn", "section-without-citation", "doc_id"),
        _finding(_reports(t).filter(~F.col("text").rlike("(?i)" + vocab.AS_OF)), "error", "no-currency-line", "doc_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""SELECT 'error' AS severity, 'graph-dangling-edge' AS "check", source || '>' || target AS subject FROM {_E} WHERE target NOT IN (SELECT id FROM {_N})
UNION ALL SELECT 'error', CASE WHEN s.id IS NULL THEN 'graph-unknown-id' WHEN i.id IS NULL THEN 'graph-excluded-source' ELSE 'graph-unread-source' END, a.id FROM (SELECT DISTINCT source AS id FROM screening WHERE source IS NOT NULL) a LEFT JOIN sources s ON s.id = a.id LEFT JOIN inc i ON i.id = a.id WHERE s.id IS NULL OR i.id IS NULL OR s.read_at IS NULL
UNION ALL SELECT 'error', 'graph-empty', 'nodes' FROM (SELECT count(*) AS n FROM {_N}) WHERE n = 0
UNION ALL SELECT 'error', 'graph-node-without-id', CAST(delivery_id AS VARCHAR) FROM oa_works WHERE id IS NULL""")
def graph_findings(t: Ledger) -> DataFrame:
    """Edges without an end, ledger ids that don't stand, nodes without id, an empty graph."""
    nodes = texts._nodes(t)
    empty = nodes.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit("nodes").alias("n"))
    out = _finding(texts.graph_dangling(t).filter("side = 'target'"), "error", "graph-dangling-edge", "source", "target")
    out = out.unionByName(_finding(texts.graph_ids(t).filter("state <> 'ok'"), "error", F.col("state"), "id"))
    out = out.unionByName(_finding(empty, "error", "graph-empty", "n"))
    return out.unionByName(_finding(t.oa_works.filter("id is null"), "error", "graph-node-without-id", "delivery_id"))


@query("SELECT count(*) AS records, CAST(sum(length(coalesce(title, ''))) AS BIGINT) AS title_chars, CAST(sum(coalesce(len(authors), 0)) AS BIGINT) AS authors, CAST(sum(coalesce(year, 0)) AS BIGINT) AS years FROM recs")
def record_envelope(t: Ledger) -> DataFrame:
    """Records written as JSON lines to the shared folder and read back by their schema: nothing is lost on the way."""
    rows = t.recs.select("rec_id", "title", "year", "authors")
    path = f"{Scratch(t.spark, 'records').root}/json"
    rows.write.json(path)
    back = t.spark.read.schema(rows.schema).json(path)
    return back.agg(F.count("rec_id").alias("records"), F.sum(F.length(F.coalesce("title", F.lit("")))).alias("title_chars"), F.sum(F.greatest(F.coalesce(F.size("authors"), F.lit(0)), F.lit(0))).alias("authors"), F.sum(F.coalesce("year", F.lit(0))).alias("years"))


@query(f"""SELECT severity, "check", doc_id || key AS subject FROM (SELECT doc_id, doc_id % 7 AS d FROM {_REPORTS}) JOIN (SELECT unnest(['no-stats-block', 'stats-block-unterminated', 'stats-block-unparseable', 'stats-block-unknown-key', 'stats-block-stale', 'stats-block-stale']) AS "check", unnest([0, 1, 2, 3, 4, 5]) AS w, unnest(['warn', 'error', 'error', 'warn', 'error', 'error']) AS severity, unnest(['', '', '', '>screens', '>read', '>claims']) AS key) ON d = w""")
def report_counts(t: Ledger) -> DataFrame:
    """Findings about the blocks of counts in reports.

    The given reports carry none, so each gets one with the ledger's counts, as it would be pasted in; by the remainder of its number by 7 the block is left out,
    loses its end mark, is broken, gains a key or has one of two counts changed.
    """
    from .review import QUERIES as review_queries

    truth = review_queries["stats_payload"](t.spark, t.folder)
    held = truth.agg(*[F.max(F.when(F.col("key") == k, F.col("n"))).alias(k) for k in ("identified", "read", "evidence", "claims")])
    k = F.col("doc_id") % 7
    rows = _reports(t).crossJoin(F.broadcast(held))  # one row
    rows = rows.withColumn("read", F.col("read") + F.when(k == 4, 1).otherwise(0)).withColumn("claims", F.col("claims") - F.when(k == 5, 2).otherwise(0))
    names = ("identified", "read", "evidence", "claims")
    body = F.when(k == 3, F.to_json(F.struct(*names, F.lit(1).alias("screens")))).otherwise(F.to_json(F.struct(*names)))
    block = reports.counts_block(F.when(k == 2, F.substring(body, 1, 9)).otherwise(body))
    block = F.when(k == 1, F.replace(block, F.lit(reports.COUNTS_CLOSE), F.lit(""))).otherwise(block)
    text = F.when(k == 0, F.col("text")).otherwise(F.concat_ws("\n", "text", block))
    return reports.counts_findings(rows.select("doc_id", text.alias("text")), truth)


_GF = """(SELECT delivery_id AS file, id, 'S' || lpad(CAST(delivery_id * 7 AS VARCHAR), 9, '0') AS lid, list_filter(coalesce(referenced_works, []), lambda x: x IS NOT NULL) AS refs, coalesce(len(list_filter(coalesce(referenced_works, []), lambda x: x IS NOT NULL)), 0) AS n FROM oa_works WHERE delivery_id % 11 <> 0)"""


@query(f"""SELECT 'error' AS severity, 'graph-unparseable' AS "check", CAST(delivery_id AS VARCHAR) AS subject FROM oa_works WHERE delivery_id % 11 = 0
 UNION ALL SELECT 'error', 'graph-node-without-id', file || '>node 0' FROM {_GF} WHERE coalesce(id, '') = ''
 UNION ALL SELECT 'error', 'graph-edge-endpoint-missing', file || '>edge ' || i || '>source' FROM (SELECT file, unnest(range(n)) AS i FROM {_GF} WHERE coalesce(id, '') = '')
 UNION ALL SELECT 'error', 'graph-dangling-edge', file || '>edge ' || i || '>' || r FROM (SELECT file, id, unnest(range(n)) AS i, unnest(refs) AS r FROM {_GF}) WHERE r <> '' AND r IS DISTINCT FROM id
 UNION ALL SELECT 'error', 'graph-edge-endpoint-missing', file || '>edge ' || i || '>target' FROM (SELECT file, unnest(range(n)) AS i, unnest(refs) AS r FROM {_GF}) WHERE r = ''
 UNION ALL SELECT 'warn', 'graph-count-mismatch', file || '>edges' FROM {_GF} WHERE file % 5 = 0
 UNION ALL SELECT 'warn', 'graph-without-ledger-id', file || '>edge ' || i FROM (SELECT file, unnest(range(n)) AS i FROM {_GF}) WHERE i % 2 = 1
 UNION ALL SELECT 'error', 'graph-bad-id', file || '>edge ' || i || '>X1' FROM (SELECT file, unnest(range(n)) AS i FROM {_GF}) WHERE i % 4 = 0
 UNION ALL SELECT 'error', CASE WHEN s.id IS NULL THEN 'graph-unknown-id' WHEN i.id IS NULL THEN 'graph-excluded-source' ELSE 'graph-unread-source' END, file || '>node 0>' || lid FROM {_GF} g LEFT JOIN sources s ON s.id = lid LEFT JOIN inc i ON i.id = lid WHERE s.id IS NULL OR i.id IS NULL OR s.read_at IS NULL""")
def graph_file_findings(t: Ledger) -> DataFrame:
    """Findings about graph files as JSON text.

    Each delivered work is a file here: one node for the work with a ledger id, an edge for each work it refers to; every eleventh file is cut off, every
    fifth declares an edge too many, odd edges lack ledger ids and every fourth edge lists one in no ledger form.
    """
    from ..operators import graphs

    d = F.col("delivery_id")
    refs = F.filter(F.coalesce("referenced_works", F.array().cast("array<string>")), lambda x: x.isNotNull())
    edges = F.transform(refs, lambda r, i: F.struct(F.col("id").alias("source"), r.alias("target"), F.when(i % 4 == 0, F.array(F.lit("[x1]"))).when(i % 2 == 0, F.array(F.lit("E000000001"))).otherwise(F.array().cast("array<string>")).alias("ledger_ids")))
    node = F.struct(F.col("id"), F.array(F.concat(F.lit("S"), F.lpad((d * 7).cast("string"), 9, "0"))).alias("ledger_ids"))
    count = F.struct(F.lit(1).alias("node_count"), (F.size(refs) + F.when(d % 5 == 0, 1).otherwise(0)).alias("edge_count"))
    text = F.to_json(F.struct(F.array(node).alias("nodes"), edges.alias("edges"), count.alias("metadata")))
    files = t.oa_works.select(d.alias("file"), text.alias("text")).withColumn("text", F.when(F.col("file") % 11 == 0, F.substring("text", 1, 30)).otherwise(F.col("text")))
    known = t.sources.select("id")
    for df in (t.ev, t.claims, t.verification):
        known = known.unionByName(df.select("id"))
    state = t.sources.select("id", F.col("read_at").isNotNull().alias("was_read")).join(t.included.withColumn("included", F.lit(True)), "id", "left")
    return graphs.file_findings(files, known.distinct(), state)
