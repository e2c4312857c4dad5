"""Similarity, streaming, and the remaining inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text
from ..operators import similarity
from ..streaming import latest
from .review import AS_OF_YEAR
from .texts import _ENTRIES, _TOKENS, _entries
from .views import SQL, Ledger

QUERIES, ORACLES = {}, {}


def query(sql: str | None, views: bool = False):
    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Ledger(spark, folder))
        if sql:
            ORACLES[f.__name__] = (SQL if views else "") + sql
        return f

    return add


_SETS = f"(SELECT doc_id * 100000 + line AS id, {_TOKENS.format('text')} AS w FROM {_ENTRIES} WHERE text <> '')"


@query(f"WITH s AS (SELECT id, w FROM {_SETS} WHERE len(w) > 0) SELECT a.id, (SELECT min(id) FROM s c WHERE c.w = a.w) AS class_id, (SELECT count(*) FROM s b WHERE b.id <> a.id AND len(list_intersect(a.w, b.w)) >= 0.8 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) - 1e-9) AS links FROM s a")
def jaccard_pairs(t: Ledger) -> DataFrame:
    """Memory entries with their class of equal word sets and the number of entries at least 0.8 similar."""
    e = _entries(t).withColumn("id", F.col("doc_id") * 100000 + F.col("line"))
    return similarity.linked(e, text.tokens(F.col("text")), vocab.SAME_ENTRY)


@query("SELECT source, reviewer, verdict, reason, stage, seq FROM lv", True)
def stream_latest_verdict(t: Ledger) -> DataFrame:
    """The streaming form, drained over what is there now."""
    return latest.drain(latest.latest_stream(latest.read_log(t.spark, f"{t.folder}/screening.parquet*", t.screening.schema)))


@query("SELECT CAST(time_bucket(INTERVAL 7 DAY, at_time, TIMESTAMP '1970-01-01') AS VARCHAR) AS week, count(*) AS n FROM screening WHERE at_time IS NOT NULL GROUP BY 1")
def stream_weekly_decisions(t: Ledger) -> DataFrame:
    """Windowed counts of the stream; complete mode keeps every week."""
    rows = latest.drain(latest.counts_by_window(latest.read_log(t.spark, f"{t.folder}/screening.parquet*", t.screening.schema)))
    return rows.select(F.col("start").cast("string").alias("week"), "n")


@query("SELECT DISTINCT claim, source, count(*) OVER (PARTITION BY claim) - 1 AS partners FROM (SELECT DISTINCT claim, source FROM cs WHERE source IS NOT NULL)", True)
def cooccurrence_edges(t: Ledger) -> DataFrame:
    """Sources of a claim with the number of other sources they occur with there."""
    from .review import claim_support_rows

    rows = claim_support_rows(t).filter("source is not null").select("claim", "source").distinct()
    return rows.join(rows.groupBy("claim").agg((F.count(F.lit(1)) - 1).alias("partners")), "claim")


@query("SELECT source, count(DISTINCT id) AS strength, round(avg(score), 6) AS mean_score FROM ev WHERE source IS NOT NULL GROUP BY 1", True)
def edge_strength(t: Ledger) -> DataFrame:
    return t.ev.filter("source is not null").groupBy("source").agg(F.countDistinct("id").alias("strength"), F.round(F.avg("score"), 6).alias("mean_score"))


#: Spellings of kinds and what they stand for.
ALIASES = (("JournalArticle", "article"), ("journal-article", "article"), ("conference-paper", "article"), ("unknown", "other"))


@query("SELECT coalesce(b, kind, 'other') AS kind, count(*) AS n FROM recs LEFT JOIN (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ALIASES) + ") x(a, b) ON a = kind GROUP BY 1")
def entity_alias(t: Ledger) -> DataFrame:
    """Kinds under their canonical names: a small fixed table, broadcast."""
    table = F.broadcast(t.spark.createDataFrame(list(ALIASES), "kind string, canonical string"))
    return t.recs.select("kind").join(table, "kind", "left").groupBy(F.coalesce("canonical", "kind", F.lit("other")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT question AS section, count(DISTINCT source) AS sources, CASE WHEN count(DISTINCT source) >= 3 THEN 'covered' WHEN count(DISTINCT source) > 0 THEN 'thin' ELSE 'empty' END AS state FROM ev WHERE question IS NOT NULL GROUP BY 1", True)
def outline_coverage(t: Ledger) -> DataFrame:
    """Every question of the outline by the number of its sources; records whose source isn't known leave it empty."""
    rows = t.ev.filter("question is not null").groupBy(F.col("question").alias("section")).agg(F.countDistinct("source").alias("sources"))
    return rows.withColumn("state", F.when(F.col("sources") >= 3, "covered").when(F.col("sources") > 0, "thin").otherwise("empty"))


@query("SELECT source, e.key AS criterion, count(DISTINCT e.value) AS answers FROM (SELECT source, unnest(map_entries(criteria)) AS e FROM screening WHERE source IS NOT NULL) WHERE e.value IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT e.value) > 1")
def criterion_conflicts(t: Ledger) -> DataFrame:
    """Criteria of a source that were answered in different ways."""
    rows = t.screening.filter("source is not null").select("source", F.explode("criteria").alias("criterion", "value")).filter("value is not null")
    return rows.groupBy("source", "criterion").agg(F.countDistinct("value").alias("answers")).filter("answers > 1")


@query("SELECT id, coalesce(nullif(metadata_at, ''), CAST(CAST(read_at AS DATE) AS VARCHAR)) AS metadata_at, coalesce(kind, 'unknown') AS kind, coalesce(interest_disclosure, 'unclear') AS interest_disclosure, coalesce(read_scope, CASE WHEN read_at IS NOT NULL THEN 'fulltext' END) AS read_scope FROM sources")
def ledger_backfill(t: Ledger) -> DataFrame:
    """Defaults for fields that older rows lack."""
    return t.sources.select(
        "id", F.coalesce(F.nullif("metadata_at", F.lit("")), F.to_date("read_at").cast("string")).alias("metadata_at"), F.coalesce("kind", F.lit("unknown")).alias("kind"),
        F.coalesce("interest_disclosure", F.lit("unclear")).alias("interest_disclosure"), F.coalesce("read_scope", F.when(F.col("read_at").isNotNull(), "fulltext")).alias("read_scope"),
    )


_RETURN = "delivery_id bigint, authorships array<struct<author:struct<display_name:string>,position_tag:string>>, referenced_works array<string>"


@query("SELECT delivery_id, a.author.display_name AS author, a.position_tag AS position_tag FROM (SELECT delivery_id, unnest(authorships) AS a FROM oa_works) WHERE a IS NOT NULL")
def executor_ingest(t: Ledger) -> DataFrame:
    """Nested documents that arrive as JSON text, read with an explicit schema and flattened."""
    docs = t.oa_works.select(F.to_json(F.struct("delivery_id", "authorships", "referenced_works")).alias("doc"))
    parsed = docs.select(F.from_json("doc", _RETURN).alias("d"))
    return parsed.select("d.delivery_id", F.explode("d.authorships").alias("a")).filter("a is not null").select("delivery_id", F.col("a.author.display_name").alias("author"), F.col("a.position_tag").alias("position_tag"))


_REFUSED = r"lower(s) IN ({blank}) OR (length(lower(s)) <= 30 AND ({patterns}))".format(
    blank=", ".join(f"'{b}'" for b in vocab.BLANK_ENTRIES), patterns=" OR ".join("regexp_matches(lower(s), '" + p.replace("'", "''") + "')" for p in vocab.REFUSALS)
)
_SAME = f"len(list_intersect(n.w, m.w)) >= {vocab.SAME_ENTRY} * (len(n.w) + len(m.w) - len(list_intersect(n.w, m.w))) - 1e-9"


@query(rf"""SELECT id, CASE WHEN blank THEN 'blank' WHEN length(s) > 200 THEN 'too-long' WHEN regexp_matches(s, '\[(?:S|E|CL|V)\d{{2,3}}\]') THEN 'cites-ids' WHEN EXISTS (SELECT 1 FROM m WHERE len(n.w) > 0 AND len(m.w) > 0 AND {_SAME}) THEN 'remembered' ELSE 'accept' END AS decision, regexp_matches(s, '\d+(?:\.\d+)?\s?%') AS has_percentage
 FROM (SELECT id, s, {_REFUSED.replace("lower(s)", "trim(regexp_replace(lower(s), '[.!…]+$', ''))")} AS blank, {_TOKENS.format('s')} AS w FROM (SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(summary, '\s+', ' ', 'g'), '^[-*•\s]+', ''), '\s+([,.;:])', '\1', 'g')) AS s FROM ev WHERE summary IS NOT NULL)) n""".replace(" FROM m ", " FROM (SELECT DISTINCT " + _TOKENS.format("text") + f" AS w FROM {_ENTRIES} WHERE text <> '') m "), True)
def memory_add_decision(t: Ledger) -> DataFrame:
    """What the memory would do with each summary, first rule first: a blank or a refusal, too long, citing ledger ids, already remembered, or accepted.

    Remembered is what some stored entry equals to 0.8 or more in words.  A percentage is only worth a warning.
    """
    s = text.normalised(F.col("summary"))
    rows = t.ev.filter("summary is not null").select("id", s.alias("s"))
    held = similarity.like_any(rows.select("id", text.tokens(F.col("s")).alias("words")), _entries(t).select(text.tokens(F.col("text")).alias("words")), vocab.SAME_ENTRY)
    s = F.col("s")
    d = F.when(text.memory_refusal(s), "blank").when(F.length(s) > vocab.MEMORY_CHARS, "too-long").when(s.rlike(r"\[(?:S|E|CL|V)\d{2,3}\]"), "cites-ids").when(F.col("held"), "remembered").otherwise("accept")
    return rows.join(held.withColumn("held", F.lit(True)), "id", "left").select("id", d.alias("decision"), s.rlike(r"\d+(?:\.\d+)?\s?%").alias("has_percentage"))


@query(f"SELECT id, authors IS NULL OR len(authors) = 0 AS no_authors, year > {AS_OF_YEAR} + 1 AS implausible, coalesce(title, '') = '' AS no_title FROM sources")
def source_flags(t: Ledger) -> DataFrame:
    return t.sources.select("id", (F.coalesce(F.size("authors"), F.lit(0)) <= 0).alias("no_authors"), (F.col("year") > AS_OF_YEAR + 1).alias("implausible"), (F.coalesce("title", F.lit("")) == "").alias("no_title"))


@query("SELECT 'S' AS type, count(*) AS ids FROM sources UNION ALL SELECT 'E', count(*) FROM ev UNION ALL SELECT 'CL', count(*) FROM claims UNION ALL SELECT 'V', count(*) FROM verification", True)
def known_ids(t: Ledger) -> DataFrame:
    out = None
    for kind, df in (("S", t.sources), ("E", t.ev), ("CL", t.claims), ("V", t.verification)):
        one = df.agg(F.count(F.lit(1)).alias("ids")).select(F.lit(kind).alias("type"), "ids")
        out = one if out is None else out.unionByName(one)
    return out
