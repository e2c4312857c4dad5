"""Text, report, memory, graph and batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import vocab
from ..functions import identity, text
from ..operators import graphs, ingest, reports, similarity
from ..operators.skew import salted_lookup
from .audits import AUTHOR_KEYS, MISSING, numbers
from .views import SQL, Ledger

QUERIES, ORACLES = {}, {}


def query(sql: str | None, views: bool = False):
    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Ledger(spark, folder))
        if sql:
            ORACLES[f.__name__] = (SQL if views else "") + sql
        return f

    return add


def _reports(t: Ledger) -> DataFrame:
    return t.documents.filter("doc_kind in ('report', 'fulltext')").select("doc_id", "text")


_REPORTS = "(SELECT doc_id, text FROM documents WHERE doc_kind IN ('report', 'fulltext'))"
_PROSE = r"regexp_split_to_array(regexp_replace(regexp_replace(text, '(?s)```.*?```', chr(10), 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?im)^##+[ \t]*(?:references|tài liệu tham khảo|bibliography)\b.*$')[1]"
_PARAS = rf"(SELECT doc_id, place, regexp_replace(p, '^\s+|\s+$', '', 'g') AS paragraph FROM (SELECT doc_id, generate_subscripts(a, 1) - 1 AS place, unnest(a) AS p FROM (SELECT doc_id, regexp_split_to_array({_PROSE}, '\n\s*\n') AS a FROM {_REPORTS})))"
_CITED = rf"(SELECT DISTINCT doc_id, unnest(regexp_extract_all({_PROSE}, '\[((?:S|E|CL)\d+)\]', 1)) AS cited FROM {_REPORTS})"


@query(f"SELECT id, array_to_string({numbers('summary')}, ' ') AS figures FROM ev", True)
def numbers_in(t: Ledger) -> DataFrame:
    return t.ev.select("id", ingest.figures(F.col("summary")).alias("figures"))


@query(f"SELECT id, array_to_string(list_sort({MISSING}), ' ') AS missing FROM ev WHERE quote <> ''", True)
def numbers_missing(t: Ledger) -> DataFrame:
    return t.ev.filter("quote <> ''").select("id", F.array_join(F.array_sort(text.numbers_missing(F.col("summary"), F.col("quote"))), " ").alias("missing"))


@query(f"SELECT id, a AS name, author FROM {AUTHOR_KEYS}")
def author_key(t: Ledger) -> DataFrame:
    return t.sources.select("id", F.explode("authors").alias("name")).withColumn("author", identity.author_key(F.col("name")))


@query(f"SELECT author, count(DISTINCT id) AS sources FROM {AUTHOR_KEYS} WHERE author IS NOT NULL GROUP BY 1 HAVING count(DISTINCT id) >= 2")
def shared_authors(t: Ledger) -> DataFrame:
    keys = t.sources.select("id", F.explode("authors").alias("a")).select("id", identity.author_key(F.col("a")).alias("author")).filter("author is not null").distinct()
    return keys.groupBy("author").agg(F.count(F.lit(1)).alias("sources")).filter("sources >= 2")


_TOKENS = r"list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in vocab.STOP_WORDS) + "], w))))"


@query("SELECT id, array_to_string(" + _TOKENS.format("summary") + ", ' ') AS tokens FROM ev", True)
def tokens(t: Ledger) -> DataFrame:
    return t.ev.select("id", F.array_join(F.array_sort(text.tokens(F.col("summary"))), " ").alias("tokens"))


@query("SELECT id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) END AS similarity FROM (SELECT id, " + _TOKENS.format("summary") + " AS a, " + _TOKENS.format("quote") + " AS b FROM ev WHERE quote IS NOT NULL)", True)
def summary_overlap(t: Ledger) -> DataFrame:
    """Overlap of each record's summary with its own quote."""
    return t.ev.filter("quote is not null").select("id", F.round(text.similarity(text.tokens(F.col("summary")), text.tokens(F.col("quote"))), 6).alias("similarity"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^[-*•\s]+', ''), '\s+([,.;:])', '\1', 'g')) AS text FROM documents")
def memory_normalise(t: Ledger) -> DataFrame:
    return t.documents.select("doc_id", text.normalised(F.col("text")).alias("text"))


@query(r"""WITH a AS (SELECT doc_id, replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '<(?:script|style).*?</(?:script|style)>', ' ', 'gis'), '</(p|div|section|h[1-6]|li|tr|br)>|<br\s*/?>', chr(10), 'gi'), '<[^>]+>', ' ', 'g'),
 '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"') AS s FROM documents), b AS (SELECT doc_id, list_reduce(list_prepend(s, list_distinct(regexp_extract_all(s, '&#(\d{1,7});', 1))), lambda acc, c: replace(acc, '&#' || c || ';', chr(CAST(c AS INTEGER)))) AS s FROM a)
 SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '(?m)^[ \t]+', '', 'g'), '(?m)[ \t]+$', '', 'g'), '^\s+|\s+$', '', 'g') AS text FROM b""")
def strip_tags(t: Ledger) -> DataFrame:
    return t.documents.select("doc_id", text.plain_markup(F.col("text")).alias("text"))


@query(r"SELECT rec_id, regexp_replace(url || '?api_key=' || rec_id || '&page=1', '([?&]api_key=)[^&]*', '\1<redacted>', 'gi') AS url FROM recs WHERE url IS NOT NULL")
def redact_url(t: Ledger) -> DataFrame:
    return t.recs.filter("url is not null").select("rec_id", text.redacted(F.concat("url", F.lit("?api_key="), F.col("rec_id").cast("string"), F.lit("&page=1"))).alias("url"))


@query("SELECT q, word AS suggestion, CAST(d AS INTEGER) AS distance FROM (SELECT q, word, levenshtein(q, word) AS d FROM (SELECT DISTINCT source || 'x' AS q FROM queries), (SELECT unnest(['openalex', 's2', 'crossref', 'europepmc', 'manual']) AS word)) WHERE d <= greatest(2, length(q) // 3) QUALIFY row_number() OVER (PARTITION BY q ORDER BY d, word) = 1")
def flag_suggest(t: Ledger) -> DataFrame:
    """The nearest of five known words, if near enough."""
    words = F.array(*[F.struct(F.levenshtein(F.col("q"), F.lit(w)).alias("distance"), F.lit(w).alias("suggestion")) for w in ("openalex", "s2", "crossref", "europepmc", "manual")])
    best = t.queries.select(F.concat("source", F.lit("x")).alias("q")).distinct().select("q", F.array_min(words).alias("b"))
    return best.select("q", "b.suggestion", "b.distance").filter("distance <= greatest(2, floor(length(q) / 3))")


@query("SELECT lang, regexp_matches(coalesce(lang, ''), '^(auto|[a-z]{2,3}(-[A-Za-z0-9]{2,8})*)$') AS valid, count(*) AS n FROM queries GROUP BY 1, 2")
def lang_tag_valid(t: Ledger) -> DataFrame:
    return t.queries.groupBy("lang", identity.language_tag(F.coalesce("lang", F.lit(""))).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, length({_PROSE}) AS chars FROM {_REPORTS}")
def report_prose(t: Ledger) -> DataFrame:
    return _reports(t).select("doc_id", F.length(text.prose(F.col("text"))).cast("bigint").alias("chars"))


@query(f"SELECT doc_id, cited FROM {_CITED}")
def citations(t: Ledger) -> DataFrame:
    return reports.citations(_reports(t))


_STATE = "CASE WHEN cited LIKE 'S%' AND s.id IS NOT NULL THEN CASE WHEN i.id IS NULL THEN 'citation-to-excluded-source' WHEN s.read_at IS NULL THEN 'citation-to-unread-source' ELSE 'ok' END WHEN e.id IS NOT NULL OR c.id IS NOT NULL THEN 'ok' ELSE 'citation-unknown-id' END"


@query(f"SELECT doc_id, cited, {_STATE} AS state FROM {_CITED} LEFT JOIN sources s ON s.id = cited LEFT JOIN inc i ON i.id = cited LEFT JOIN ev e ON e.id = cited LEFT JOIN claims c ON c.id = cited", True)
def citation_check(t: Ledger) -> DataFrame:
    """Each citation of each report against the ledger; a citation may be hot, so known ids are looked up with salts."""
    s = t.sources.select(F.col("id").alias("cited"), "read_at", F.lit("S").alias("type"))
    i = t.included.select(F.col("id").alias("cited"), F.lit(True).alias("inc"))
    others = t.ev.select(F.col("id").alias("cited")).unionByName(t.claims.select(F.col("id").alias("cited"))).select("cited", F.lit(None).cast("timestamp_ntz").alias("read_at"), F.lit("O").alias("type"))
    known = s.unionByName(others).join(i, "cited", "left")
    rows = salted_lookup(reports.citations(_reports(t)), known, ["cited"], "doc_id", "left")
    state = F.when(F.col("type").isNull(), "citation-unknown-id").when(F.col("type") == "O", "ok").when(F.col("inc").isNull(), "citation-to-excluded-source").when(F.col("read_at").isNull(), "citation-to-unread-source").otherwise("ok")
    return rows.select("doc_id", "cited", state.alias("state"))


@query(f"SELECT id AS claim FROM claims WHERE consensus <> 'absent' AND id IN (SELECT claim FROM cs WHERE source IN (SELECT id FROM sources)) AND id NOT IN (SELECT cited FROM {_CITED}) AND id NOT IN (SELECT claim FROM cs WHERE source IN (SELECT cited FROM {_CITED}))", True)
def claim_absent(t: Ledger) -> DataFrame:
    """Claims with backing of which nothing is cited in any report."""
    from .review import claim_support_rows

    cited = reports.citations(_reports(t)).select("cited").distinct()
    back = claim_support_rows(t).join(t.sources.select(F.col("id").alias("source")), "source", "left_semi").select("claim", "source").distinct()
    shown = back.join(cited.withColumnRenamed("cited", "source"), "source", "left_semi").select("claim").distinct()
    rows = t.claims.filter("consensus <> 'absent'").select(F.col("id").alias("claim")).join(back, "claim", "left_semi")
    return rows.join(cited.withColumnRenamed("cited", "claim"), "claim", "left_anti").join(shown, "claim", "left_anti")


@query(rf"""SELECT doc_id, place FROM {_PARAS} WHERE paragraph <> '' AND NOT regexp_matches(paragraph, '^[#|>]') AND NOT regexp_matches(paragraph, '\[((?:S|E|CL)\d+)\]')
 AND (regexp_matches(paragraph, '(^|[^\p{{L}}\d._-])\d+(?:[.,]\d+)?\s*%') OR regexp_matches(regexp_replace(paragraph, '\b(19|20)\d{{2}}\b', ' ', 'g'), '(^|[^\p{{L}}\d._-])\d{{2,}}($|[^\d\p{{L}}-])'))""")
def bare_figures(t: Ledger) -> DataFrame:
    return reports.bare_figures(_reports(t))


@query(rf"""SELECT doc_id, count(*) AS sections FROM (SELECT doc_id, unnest(regexp_split_to_array(chr(10) || {_PROSE}, '\n##\s+')[2:]) AS s FROM {_REPORTS}) WHERE length(regexp_replace(regexp_replace(s, '^[^\n]+', ''), '^\s+|\s+$', '', 'g')) > 400 AND NOT regexp_matches(s, '\[((?:S|E|CL)\d+)\]') GROUP BY 1""")
def uncited_sections(t: Ledger) -> DataFrame:
    s = reports.sections(_reports(t)).filter((F.length("body") > 400) & ~F.col("body").rlike(vocab.CITATION) & ~F.col("heading").rlike(vocab.CITATION))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sections"))


@query(f"SELECT doc_id, regexp_matches(text, '(?i)evidence current as of|bằng chứng cập nhật đến') AS has_line FROM {_REPORTS}")
def currency_line(t: Ledger) -> DataFrame:
    return _reports(t).select("doc_id", F.col("text").rlike("(?i)" + vocab.AS_OF).alias("has_line"))


@query(f"SELECT doc_id FROM {_REPORTS} WHERE doc_id NOT IN (SELECT doc_id FROM {_CITED})")
def report_uncited(t: Ledger) -> DataFrame:
    return _reports(t).select("doc_id").join(reports.citations(_reports(t)), "doc_id", "left_anti")


_MEMORY = r"""(SELECT doc_id, line, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line), 'preference') AS kind, s FROM (SELECT doc_id, line, s, CASE WHEN regexp_matches(s, '^##\s+\w+\s*$') THEN regexp_extract(s, '^##\s+(\w+)', 1) END AS h FROM (SELECT doc_id, generate_subscripts(a, 1) - 1 AS line, unnest(a) AS s FROM (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS a FROM documents WHERE doc_kind = 'memory'))))"""
_ENTRY = r"^\s*-\s*\[(\d{4}-\d{2}-\d{2})\]\s*(.*?)(?:\s*\{tags:\s*([^}]*)\})?\s*$"
_ENTRIES = f"(SELECT doc_id, line, kind, regexp_extract(s, '{_ENTRY}', 1) AS date, regexp_extract(s, '{_ENTRY}', 2) AS text, regexp_extract(s, '{_ENTRY}', 3) AS tags FROM {_MEMORY} WHERE regexp_matches(s, '^\\s*-\\s*\\[\\d{{4}}-\\d{{2}}-\\d{{2}}\\]'))"


def _entries(t: Ledger) -> DataFrame:
    return reports.memory_entries(t.documents.filter("doc_kind = 'memory'").select("doc_id", "text"))


@query(f"SELECT doc_id, line, kind, date, text, tags FROM {_ENTRIES} WHERE text <> ''")
def memory_parse(t: Ledger) -> DataFrame:
    return _entries(t)


@query("SELECT kind, count(date) AS n, min(date) AS oldest, max(date) AS newest, coalesce(max(length(text)), 0) AS longest, count(*) FILTER (length(text) > 200) AS too_long FROM (SELECT unnest([" + ", ".join(f"'{k}'" for k in vocab.MEMORY_KINDS) + f"]) AS kind UNION SELECT kind FROM {_ENTRIES} WHERE text <> '') k LEFT JOIN (SELECT * FROM {_ENTRIES} WHERE text <> '') e USING (kind) GROUP BY 1")
def memory_stats(t: Ledger) -> DataFrame:
    """Every kind that there is or may be, with zeros where it has no entry."""
    kinds = t.spark.createDataFrame([(k,) for k in vocab.MEMORY_KINDS], "kind string")
    n = _entries(t).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("oldest"), F.max("date").alias("newest"), F.max(F.length("text")).cast("bigint").alias("longest"), F.count_if(F.length("text") > vocab.MEMORY_CHARS).alias("too_long"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return kinds.join(n, "kind", "full").select("kind", zero("n"), "oldest", "newest", zero("longest"), zero("too_long"))


@query(f"SELECT doc_id, line, kind, date, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY date DESC, line) AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY date DESC, line) AS rk FROM {_ENTRIES} WHERE text <> '') WHERE rk <= 12) WHERE place <= 40")
def memory_caps(t: Ledger) -> DataFrame:
    return reports.capped(_entries(t)).select("doc_id", "line", "kind", "date", "place")


@query(rf"SELECT doc_id, line, regexp_matches(text, '\d+(?:\.\d+)?\s?%') AS percentage, regexp_matches(text, '\b(19|20)\d{{2}}\b') AS year, regexp_matches(text, '(?i)\b(this run|this report|this study)\b') AS run_specific, regexp_matches(text, '\[(?:S|E|CL|V)\d+\]') AS cites FROM {_ENTRIES} WHERE text <> ''")
def memory_screen(t: Ledger) -> DataFrame:
    s = F.col("text")
    return _entries(t).select("doc_id", "line", s.rlike(r"\d+(?:\.\d+)?\s?%").alias("percentage"), s.rlike(r"(?<![A-Za-z0-9_])(19|20)\d{2}(?![A-Za-z0-9_])").alias("year"), s.rlike(r"(?i)\b(this run|this report|this study)\b").alias("run_specific"), s.rlike(r"\[(?:S|E|CL|V)\d+\]").alias("cites"))


@query(f"SELECT text_key, min(doc_id) AS doc_id, count(*) AS entries FROM (SELECT doc_id, array_to_string({_TOKENS.format('text')}, ' ') AS text_key FROM {_ENTRIES} WHERE text <> '') GROUP BY 1 HAVING count(*) > 1")
def memory_fold(t: Ledger) -> DataFrame:
    """Entries of all files with the same content words, one row per class with its number of entries; ``memory_fold_similar`` folds near ones."""
    k = _entries(t).select("doc_id", F.array_join(F.array_sort(text.tokens(F.col("text"))), " ").alias("text_key"))
    return k.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("entries")).filter("entries > 1")


_NEAR = f"""e AS (SELECT doc_id, line, date, text, tags, {_TOKENS.format('text')} AS w FROM {_ENTRIES} WHERE text <> ''),
 p AS (SELECT *, shared >= {vocab.SAME_ENTRY} * (na + nb - shared) - 1e-9 AS same FROM (SELECT a.doc_id, a.line AS a, b.line AS b, len(list_intersect(a.w, b.w)) AS shared, len(a.w) AS na, len(b.w) AS nb FROM e a JOIN e b ON b.doc_id = a.doc_id AND b.line <> a.line) WHERE shared > 0 AND shared >= {vocab.NEAR_ENTRY} * (na + nb - shared) - 1e-9),
 r AS (SELECT doc_id, line, line AS low FROM e UNION SELECT r.doc_id, p.b, r.low FROM r JOIN p ON p.doc_id = r.doc_id AND p.a = r.line WHERE p.same),
 g AS (SELECT doc_id, line, min(low) AS fold_line FROM r GROUP BY 1, 2)"""


@query(f"""WITH RECURSIVE {_NEAR}, k AS (SELECT doc_id, fold_line, count(*) AS entries, first(text ORDER BY length(text) DESC, line) AS kept, min(date) AS since, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(string_agg(tags, ','), ','), lambda x: trim(x)), lambda x: x <> ''))), ',') AS all_tags FROM g JOIN e USING (doc_id, line) GROUP BY 1, 2)
 SELECT doc_id, line, fold_line, entries, (SELECT count(*) FROM p WHERE p.doc_id = g.doc_id AND p.a = g.line AND NOT p.same) AS near, kept, since, all_tags FROM g JOIN k USING (doc_id, fold_line)""")
def memory_fold_similar(t: Ledger) -> DataFrame:
    """Compaction within each memory file: entries of similarity 0.8 or more fold, whatever their kind, directly or through others.

    Each entry names the first line it folds into, how many entries fold there, its partners from 0.55 to below 0.8 in
    the file (for review), and what is kept of the fold: the longest text, the earliest date and all tags.
    """
    e = _entries(t).withColumn("id", F.col("doc_id") * 100000 + F.col("line"))
    in_file = F.transform(text.tokens(F.col("text")), lambda w: F.concat(F.col("doc_id").cast("string"), F.lit(" "), w))
    e = e.join(similarity.folded(e, in_file, vocab.SAME_ENTRY, vocab.NEAR_ENTRY), "id", "left")
    e = e.withColumn("fold_line", F.coalesce(F.col("group_id") % 100000, F.col("line")).cast("bigint")).withColumn("near", F.coalesce("near", F.lit(0)))
    tags = F.filter(F.transform(F.split(F.array_join(F.collect_list("tags"), ","), ","), lambda x: F.trim(x)), lambda x: x != "")
    kept = e.groupBy("doc_id", "fold_line").agg(
        F.count(F.lit(1)).alias("entries"), F.max_by("text", F.struct(F.length("text"), -F.col("line"))).alias("kept"), F.min("date").alias("since"), F.array_join(F.array_sort(F.array_distinct(tags)), ",").alias("all_tags")
    )
    return e.select("doc_id", "line", "fold_line", "near").join(kept, ["doc_id", "fold_line"])


_EDITS = f"(SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'replace' ELSE 'forget' END AS op, doc_id % 3 = 0 AS every, trim(regexp_replace(regexp_replace(regexp_replace(substr(arg_min(text, line), 1, CAST(4 + 9 * (doc_id % 4) AS INTEGER)), '\\s+', ' ', 'g'), '^[-*•\\s]+', ''), '\\s+([,.;:])', '\\1', 'g')) AS target FROM {_ENTRIES} WHERE text <> '' GROUP BY 1)"
_LIKE = f"(op = 'replace' AND len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) >= {vocab.SAME_ENTRY})"


@query(f"""SELECT doc_id, op, hits, CASE WHEN target = '' THEN 'no-target' WHEN hits = 0 THEN 'no-match' WHEN hits > 1 AND NOT (op = 'forget' AND every) THEN 'ambiguous' ELSE 'done' END AS outcome,
 n - CASE WHEN op = 'forget' AND (hits = 1 OR (hits > 1 AND every)) THEN hits ELSE 0 END AS entries, CASE WHEN op = 'replace' AND hits = 1 THEN line END AS changed
 FROM (SELECT doc_id, op, target, every, count(*) FILTER (hit) AS hits, count(*) AS n, min(line) FILTER (hit) AS line FROM (SELECT *, (target <> '' AND contains(lower(text), lower(target))) OR {_LIKE} AS hit FROM (SELECT x.*, e.line, e.text, {_TOKENS.format('e.text')} AS a, {_TOKENS.format('target')} AS b FROM {_EDITS} x JOIN (SELECT * FROM {_ENTRIES} WHERE text <> '') e USING (doc_id))) GROUP BY 1, 2, 3, 4)""")
def memory_edit(t: Ledger) -> DataFrame:
    """What an edit of each memory file does: to replace or to forget the entry that holds the beginning (of a length by the file's number) of the file's first one."""
    first = _entries(t).groupBy("doc_id").agg(F.min_by("text", "line").alias("first"))
    edits = first.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "replace").otherwise("forget").alias("op"), F.expr("substring(first, 1, cast(4 + 9 * (doc_id % 4) as int))").alias("target"), F.lit("A new lesson").alias("text"), (F.col("doc_id") % 3 == 0).alias("every"))
    return reports.memory_edits(_entries(t), edits)


def _nodes(t: Ledger) -> DataFrame:
    return t.oa_works.filter("id is not null").select("id", F.coalesce("work_type", F.lit("unknown")).alias("type")).groupBy("id").agg(F.min("type").alias("type"))


def _edges(t: Ledger) -> DataFrame:
    return t.oa_works.filter("id is not null").select(F.col("id").alias("source"), F.explode("referenced_works").alias("target")).filter("target is not null").distinct()


_N = "(SELECT id, min(coalesce(work_type, 'unknown')) AS type FROM oa_works WHERE id IS NOT NULL GROUP BY 1)"
_E = "(SELECT DISTINCT source, target FROM (SELECT id AS source, unnest(referenced_works) AS target FROM oa_works WHERE id IS NOT NULL) WHERE target IS NOT NULL)"
_D = f"(SELECT n.id, count(x.id) AS degree FROM {_N} n LEFT JOIN (SELECT source AS id FROM {_E} UNION ALL SELECT target FROM {_E}) x ON x.id = n.id GROUP BY 1)"


@query(f"SELECT id, degree FROM {_D}")
def graph_degree(t: Ledger) -> DataFrame:
    return graphs.degree(_nodes(t), _edges(t))


@query(f"SELECT id, degree FROM {_D} WHERE round(degree - (SELECT avg(degree) + 1.5 * stddev_pop(degree) FROM {_D}), 6) > 0")
def graph_hubs(t: Ledger) -> DataFrame:
    return graphs.hubs(graphs.degree(_nodes(t), _edges(t)))


@query(f"SELECT id, degree FROM {_D} WHERE degree <= 2")
def graph_isolates(t: Ledger) -> DataFrame:
    return graphs.degree(_nodes(t), _edges(t)).filter("degree <= 2")


@query(f"SELECT source, target, 'target' AS side FROM {_E} WHERE target NOT IN (SELECT id FROM {_N}) UNION ALL SELECT source, target, 'source' FROM {_E} WHERE source NOT IN (SELECT id FROM {_N})")
def graph_dangling(t: Ledger) -> DataFrame:
    return graphs.dangling(_nodes(t), _edges(t))


_B = f"(SELECT DISTINCT a, b FROM (SELECT source AS a, target AS b FROM {_E} UNION ALL SELECT target, source FROM {_E}) WHERE a <> b)"


@query(f"""WITH RECURSIVE b AS MATERIALIZED (SELECT * FROM {_B}), d AS (SELECT a, count(*) AS n FROM b GROUP BY 1),
 up AS (SELECT b.a, arg_min(b.b, (-d.n, b.b)) AS b, max(d.n) AS n FROM b JOIN d ON d.a = b.b GROUP BY 1), p AS (SELECT up.a, up.b FROM up JOIN d USING (a) WHERE up.n > d.n OR (up.n = d.n AND up.b < up.a)),
 climb AS (SELECT a AS id, a AS place FROM d UNION ALL SELECT c.id, p.b FROM climb c JOIN p ON p.a = c.place), peak AS (SELECT id, place AS cluster FROM climb WHERE place NOT IN (SELECT a FROM p))
 SELECT id, count(DISTINCT cluster) AS clusters FROM (SELECT b.a AS id, k.cluster FROM b JOIN peak k ON k.id = b.b UNION ALL SELECT id, cluster FROM peak) GROUP BY 1 HAVING count(DISTINCT cluster) >= 2""")
def graph_bridges(t: Ledger) -> DataFrame:
    """Nodes whose edges span two clusters or more; a cluster is what climbs to one locally best connected node."""
    return graphs.bridges(_edges(t))


@query(f"""WITH RECURSIVE b AS MATERIALIZED (SELECT x.* FROM {_B} x WHERE a IN (SELECT id FROM {_N}) AND b IN (SELECT id FROM {_N})), r AS (SELECT id, id AS low FROM {_N} UNION SELECT b.b, r.low FROM r JOIN b ON b.a = r.id WHERE r.low < b.b)
 SELECT id, min(low) AS label FROM r GROUP BY 1""")
def graph_clusters(t: Ledger) -> DataFrame:
    """Every node with the smallest node of its whole component."""
    return graphs.component_labels(_nodes(t), _edges(t))


@query(f"SELECT id, type, degree, rank_in_type FROM (SELECT d.id, type, degree, row_number() OVER (PARTITION BY type ORDER BY degree DESC, d.id) AS rank_in_type FROM {_D} d JOIN {_N} n ON n.id = d.id) WHERE rank_in_type <= 2")
def graph_top_entities(t: Ledger) -> DataFrame:
    """The two best connected nodes of each type (a top-k report); ``graph_top_30`` adds the best of all types."""
    d = graphs.degree(_nodes(t), _edges(t)).join(_nodes(t), "id")
    w = W.partitionBy("type").orderBy(F.desc("degree"), "id")
    return d.withColumn("rank_in_type", F.row_number().over(w).cast("bigint")).filter("rank_in_type <= 2").select("id", "type", "degree", "rank_in_type")


@query(f"SELECT id, type, degree, rank_in_type FROM (SELECT d.id, type, degree, row_number() OVER (PARTITION BY type ORDER BY degree DESC, d.id) AS rank_in_type, row_number() OVER (ORDER BY degree DESC, d.id) AS r FROM {_D} d JOIN {_N} n ON n.id = d.id) WHERE rank_in_type <= 2 OR r <= 30")
def graph_top_30(t: Ledger) -> DataFrame:
    """The 30 best connected nodes and at least two of each type.

    All better nodes of a type stand in the 30 when one of its nodes does, so the rank among those chosen is the rank in the type.
    """
    d = graphs.degree(_nodes(t), _edges(t)).join(_nodes(t), "id").select("id", "type", "degree")
    w = W.partitionBy("type").orderBy(F.desc("degree"), "id")
    two = d.withColumn("r", F.row_number().over(w)).filter("r <= 2").drop("r")
    chosen = two.unionByName(d.orderBy(F.desc("degree"), "id").limit(30)).distinct()
    return chosen.withColumn("rank_in_type", F.row_number().over(w).cast("bigint"))


@query("SELECT a.id, CASE WHEN s.id IS NULL THEN 'graph-unknown-id' WHEN i.id IS NULL THEN 'graph-excluded-source' WHEN s.read_at IS NULL THEN 'graph-unread-source' ELSE 'ok' END AS state FROM (SELECT DISTINCT source AS id FROM screening WHERE source IS NOT NULL) a LEFT JOIN sources s ON s.id = a.id LEFT JOIN inc i ON i.id = a.id", True)
def graph_ids(t: Ledger) -> DataFrame:
    """Ledger ids used elsewhere, classified: unknown, excluded, unread or fine."""
    ids = t.screening.filter("source is not null").select(F.col("source").alias("id")).distinct()
    s, i = t.sources.select("id", "read_at", F.lit(True).alias("k")), t.included.withColumn("inc", F.lit(True))
    j = ids.join(s, "id", "left").join(i, "id", "left")
    return j.select("id", F.when(F.col("k").isNull(), "graph-unknown-id").when(F.col("inc").isNull(), "graph-excluded-source").when(F.col("read_at").isNull(), "graph-unread-source").otherwise("ok").alias("state"))


@query(r"SELECT line_id, CASE WHEN s LIKE '{%' AND json_valid(s) THEN 'parsed' ELSE 'failed' END AS status FROM (SELECT line_id, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS s FROM rec_lines) WHERE s <> '' AND NOT regexp_matches(s, '^(#|//)')")
def batch_parse(t: Ledger) -> DataFrame:
    return ingest.parse_lines(t.rec_lines).select("line_id", "status")


@query(r"SELECT line_id, array_to_string(list_sort(list_distinct(list_transform(json_keys(CAST(s AS JSON)), lambda k: replace(lower(k), '_', '-')))), ',') AS fields FROM (SELECT line_id, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS s FROM rec_lines) WHERE s LIKE '{%' AND json_valid(s)")
def batch_coerce(t: Ledger) -> DataFrame:
    return ingest.parse_lines(t.rec_lines).filter("status = 'parsed'").select("line_id", F.array_join(ingest.field_names(F.col("fields")), ",").alias("fields"))


@query(r"SELECT k AS field, count(*) AS lines FROM (SELECT line_id, unnest(list_distinct(list_transform(json_keys(CAST(s AS JSON)), lambda k: replace(lower(k), '_', '-')))) AS k FROM (SELECT line_id, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS s FROM rec_lines) WHERE s LIKE '{%' AND json_valid(s)) WHERE k NOT IN ('title', 'year', 'authors') GROUP BY 1")
def unknown_keys(t: Ledger) -> DataFrame:
    rows = ingest.parse_lines(t.rec_lines).filter("status = 'parsed'")
    return rows.select(F.explode(ingest.unknown_fields(F.col("fields"), ("title", "year", "authors"))).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("lines"))


_SCREEN = r"array_to_string(list_filter([CASE WHEN s.id IS NULL THEN 'unknown-source' END, CASE WHEN NOT coalesce(c.verdict IN ('include', 'exclude', 'defer'), false) THEN 'bad-verdict' END, CASE WHEN c.verdict = 'exclude' AND coalesce(reason, '') = '' THEN 'no-reason' END, CASE WHEN reason <> '' AND reason NOT IN (" + ", ".join(f"'{r}'" for r in vocab.EXCLUSION_REASONS) + ") THEN 'bad-reason' END], lambda x: x IS NOT NULL), ',')"


@query(f"SELECT seq, {_SCREEN} AS problems FROM (SELECT seq, source, verdict, reason FROM screening) c LEFT JOIN sources s ON s.id = c.source")
def screen_validate(t: Ledger) -> DataFrame:
    s = t.sources.select(F.col("id").alias("source"), F.lit(True).alias("known"))
    return t.screening.select("seq", "source", "verdict", "reason").join(s, "source", "left").select("seq", ingest.screen_problems(F.col("known")).alias("problems"))


_EVID = f"CASE WHEN s.id IS NULL THEN 'failed:unknown-source' WHEN score IS NULL OR score < 1 OR score > 10 THEN 'failed:score-range' WHEN score < 6 THEN 'failed:below-keep' WHEN quote <> '' AND len({MISSING}) > 0 THEN 'refused:number-not-in-quote' ELSE 'applied' END"


@query(f"SELECT ev.id, {_EVID} AS status FROM ev LEFT JOIN sources s ON s.id = ev.source", True)
def evidence_validate(t: Ledger) -> DataFrame:
    s = t.sources.select(F.col("id").alias("source"), F.lit(True).alias("known"))
    return t.ev.join(s, "source", "left").select("id", ingest.evidence_status(F.col("known")).alias("status"))


@query(f"SELECT count(*) FILTER (status = 'applied') AS applied, count(*) FILTER (status LIKE 'refused%') AS refused, count(*) FILTER (status LIKE 'failed%') AS failed, CASE WHEN count(*) FILTER (status LIKE 'refused%') > 0 THEN 2 WHEN count(*) FILTER (status LIKE 'failed%') > 0 THEN 1 ELSE 0 END AS exit_code FROM (SELECT {_EVID} AS status FROM ev LEFT JOIN sources s ON s.id = ev.source)", True)
def batch_outcome(t: Ledger) -> DataFrame:
    s = F.col("status")
    one = evidence_validate(t).agg(F.count_if(s == "applied").alias("applied"), F.count_if(s.startswith("refused")).alias("refused"), F.count_if(s.startswith("failed")).alias("failed"))
    return one.withColumn("exit_code", F.when(F.col("refused") > 0, 2).when(F.col("failed") > 0, 1).otherwise(0))


@query("SELECT c.id, CASE WHEN len(evidence) = 0 THEN 'no-evidence' WHEN EXISTS (SELECT 1 FROM ce WHERE ce.claim = c.id AND eid NOT IN (SELECT id FROM ev)) THEN 'unknown-evidence' ELSE 'ok' END AS status FROM claims c", True)
def claim_validate(t: Ledger) -> DataFrame:
    bad = t.claims.select("id", F.explode("evidence").alias("eid")).join(t.ev.select(F.col("id").alias("eid")), "eid", "left_anti").select("id", F.lit(True).alias("bad")).distinct()
    return t.claims.join(bad, "id", "left").select("id", F.when(F.size("evidence") == 0, "no-evidence").when(F.col("bad"), "unknown-evidence").otherwise("ok").alias("status"))


@query("SELECT id, CASE WHEN claim NOT IN (SELECT id FROM claims) THEN 'unknown-claim' WHEN status NOT IN ('supported', 'partial', 'unsupported', 'contradicted') THEN 'bad-status' ELSE 'ok' END AS status FROM verification", True)
def verify_validate(t: Ledger) -> DataFrame:
    c = t.claims.select(F.col("id").alias("claim"), F.lit(True).alias("k"))
    return t.verification.join(c, "claim", "left").select("id", F.when(F.col("k").isNull(), "unknown-claim").when(~F.col("status").isin(*vocab.VERIFY_STATUS), "bad-status").otherwise("ok").alias("status"))


@query("SELECT s.id, CASE WHEN length(trim(r.abstract)) >= 200 THEN 'read' ELSE 'skipped' END AS state, length(trim(r.abstract)) AS chars FROM sources s JOIN recs r ON r.rec_id = s.rec_id WHERE s.read_at IS NULL")
def mark_read_all(t: Ledger) -> DataFrame:
    """What a bulk marking would read: sources whose text is long enough; the others are listed as skipped."""
    n = F.length(F.trim("abstract")).cast("bigint")
    rows = t.sources.filter("read_at is null").select("id", "rec_id").join(t.recs.select("rec_id", "abstract"), "rec_id")
    return rows.select("id", F.when(n >= vocab.MIN_CACHED_CHARS, "read").otherwise("skipped").alias("state"), n.alias("chars"))


@query("SELECT lang, word, pages FROM (SELECT lang, word, count(*) AS pages, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS r FROM (SELECT DISTINCT e.lang, e.id, w AS word FROM (SELECT s.lang, ev.id, unnest(" + _TOKENS.format("summary") + ") AS w FROM ev JOIN sources s ON s.id = ev.source) e WHERE w NOT IN (SELECT DISTINCT unnest(" + _TOKENS.format("q") + ") FROM queries)) GROUP BY 1, 2) WHERE r <= 20", True)
def vocab_gap(t: Ledger) -> DataFrame:
    """Frequent words of the evidence that no search used: the top 20 of each language (a report)."""
    words = t.ev.join(t.sources.select(F.col("id").alias("source"), "lang"), "source").select("lang", "id", F.explode(text.tokens(F.col("summary"))).alias("word"))
    used = t.queries.select(F.explode(text.tokens(F.col("q"))).alias("word")).distinct()
    n = words.join(used, "word", "left_anti").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("pages"))
    w = W.partitionBy("lang").orderBy(F.desc("pages"), "word")
    return n.withColumn("r", F.row_number().over(w)).filter("r <= 20").select("lang", "word", "pages")


@query(r"SELECT doc_id, count(*) AS sections, max(length(s)) AS longest FROM (SELECT doc_id, unnest(regexp_split_to_array(chr(10) || text, '\n#+ ')[2:]) AS s FROM documents WHERE doc_kind = 'fulltext') GROUP BY 1")
def chunk_sections(t: Ledger) -> DataFrame:
    """Full texts cut at their headings: the number of headed sections and the longest; ``chunk_texts`` gives every chunk."""
    rows = t.documents.filter("doc_kind = 'fulltext'").select("doc_id", F.explode(F.slice(F.split(F.concat(F.lit("\n"), "text"), "\n#+ "), 2, 1_000_000)).alias("s"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sections"), F.max(F.length("s")).cast("bigint").alias("longest"))


#: How far a section's figures are to be relied on; a broken encoding of é counts as é.
SECTION_RANKS = (
    (1, "results?|findings|r.{1,2}sultats|ergebnisse|resultados"), (2, "methods?|methodology|m.{1,2}thodes|methoden|m.{1,2}todos"), (3, "discussion|diskussion|discusi.{1,2}n"),
    (4, "limitations?|limites|grenzen|l.{1,2}mites"), (5, "related work"), (7, "introduction|einleitung|introducci.{1,2}n|abstract|r.{1,2}sum.{1,2}|zusammenfassung|resumen"),
)
_RANK = "CASE " + " ".join(rf"WHEN regexp_matches(heading, '(?i)^(?:[0-9.]+ +)?(?:{p})(?:[^\p{{L}}]|$)') THEN {r}" for r, p in SECTION_RANKS) + " ELSE 6 END"


@query(rf"SELECT *, {_RANK} AS rank FROM (SELECT doc_id, place, CASE WHEN place > 0 THEN regexp_replace(string_split(s, chr(10))[1], '^\s+|\s+$', '', 'g') ELSE '' END AS heading, CASE WHEN place = 0 THEN substr(s, 2) ELSE array_to_string(string_split(s, chr(10))[2:], chr(10)) END AS text FROM (SELECT doc_id, generate_subscripts(a, 1) - 1 AS place, unnest(a) AS s FROM (SELECT doc_id, regexp_split_to_array(chr(10) || text, '\n#+ ') AS a FROM documents WHERE doc_kind = 'fulltext'))) WHERE place > 0 OR regexp_matches(text, '\S')")
def chunk_texts(t: Ledger) -> DataFrame:
    """Every chunk of the full texts, cut at their headings, with its heading's rank (results 1 ... abstract and introduction 7, others 6).

    ``place`` 0 is the text before the first heading, without a heading of its own; it is left out when it is blank.  A
    text without a heading is one chunk.
    """
    rows = t.documents.filter("doc_kind = 'fulltext'").select("doc_id", F.posexplode(F.split(F.concat(F.lit("\n"), "text"), "\n#+ ")).alias("place", "s"))
    first = F.substring_index("s", "\n", 1)
    heading = F.when(F.col("place") > 0, F.regexp_replace(first, r"^\s+|\s+$", "")).otherwise("")
    body = F.when(F.col("place") == 0, F.expr("substr(s, 2)")).otherwise(F.expr("substr(s, length(substring_index(s, '\n', 1)) + 2)"))
    rows = rows.select("doc_id", F.col("place").cast("bigint").alias("place"), heading.alias("heading"), body.alias("text")).filter(r"place > 0 or text rlike '\\S'")
    rank = F.lit(6)
    for r, p in reversed(SECTION_RANKS):
        rank = F.when(F.col("heading").rlike(rf"(?i)^(?:[0-9.]+ +)?(?:{p})(?:[^\p{{L}}]|$)"), r).otherwise(rank)
    return rows.withColumn("rank", rank)


@query("""WITH RECURSIVE cells AS (SELECT source, "column" AS c, coalesce(arg_max(value, seq), '—') AS value FROM extraction GROUP BY 1, 2), columns AS (SELECT DISTINCT "column" AS c FROM extraction)
 SELECT source, '| ' || source || ' | ' || string_agg(coalesce(value, '—'), ' | ' ORDER BY c) || ' |' AS line FROM (SELECT DISTINCT source FROM extraction) CROSS JOIN columns LEFT JOIN cells USING (source, c) GROUP BY 1""".replace("WITH RECURSIVE ", ", "), True)
def extraction_matrix(t: Ledger) -> DataFrame:
    """A table line for each source with a cell for every column of the extraction, in order of their names; a missing cell is a dash.

    The columns are one row (an extraction has as many columns as its table is wide), so no source is paired with absent cells.
    """
    last = t.extraction.groupBy("source", "column").agg(F.max_by("value", "seq").alias("value"))
    columns = t.extraction.agg(F.array_sort(F.collect_set("column")).alias("columns"))
    held = last.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("column", F.coalesce("value", F.lit("—")).alias("value")))).alias("cells"))
    cells = F.transform("columns", lambda c: F.coalesce(F.col("cells")[c], F.lit("—")))
    return held.crossJoin(F.broadcast(columns)).select("source", F.concat(F.lit("| "), "source", F.lit(" | "), F.array_join(cells, " | "), F.lit(" |")).alias("line"))  # one row
