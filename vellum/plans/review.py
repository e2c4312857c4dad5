"""Review analytics: funnel, agreement, tallies and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import present
from ..operators import review
from ..operators.ranking import global_row_number
from ..operators.skew import salted_lookup
from .views import SQL, Ledger

AS_OF_YEAR = 2026
QUERIES, ORACLES = {}, {}


def query(sql: str, views: bool = True):
    """Register the function under its name, with its SQL."""

    def add(f):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(Ledger(spark, folder))

        QUERIES[f.__name__] = run
        ORACLES[f.__name__] = (SQL if views else "") + sql
        return f

    return add


@query("SELECT source, reviewer, verdict, reason, stage, seq FROM lv")
def latest_verdict(t: Ledger) -> DataFrame:
    return t.latest


@query("SELECT id, title, year, read_scope FROM sources WHERE id IN (SELECT id FROM inc)")
def included_sources(t: Ledger) -> DataFrame:
    return review.included_sources(t.sources, t.latest).select("id", "title", "year", "read_scope")


@query("SELECT p1.source, p1.verdict AS verdict_1, p2.verdict AS verdict_2, p1.verdict IS DISTINCT FROM p2.verdict AS conflict FROM p1 JOIN p2 ON p1.source = p2.source")
def dual_review(t: Ledger) -> DataFrame:
    return review.dual_review(t.latest)


@query("SELECT count(*) AS double_screened, count(*) FILTER (c) AS conflicts, CAST(round((count(*) - count(*) FILTER (c)) * 100 / nullif(count(*), 0)) AS BIGINT) AS agreement_pct FROM (SELECT p1.verdict IS DISTINCT FROM p2.verdict AS c FROM p1 JOIN p2 ON p1.source = p2.source)")
def dual_review_pct(t: Ledger) -> DataFrame:
    return review.agreement(t.latest)


_FUNNEL = """SELECT *, identified - screened AS unscreened FROM (SELECT count(*) AS identified, count(*) FILTER (metadata_at <> '' AND read_at IS NULL) AS metadata_only, count(read_at) AS read,
 count(*) FILTER (read_at IS NOT NULL AND coalesce(read_scope, '') <> 'abstract') AS read_fulltext, count(*) FILTER (coalesce(metadata_at, '') = '') AS unfetched FROM sources),
 (SELECT count(*) AS screened, count(*) FILTER (verdict = 'exclude') AS excluded, count(*) FILTER (verdict = 'include') AS included FROM p1)"""


@query(_FUNNEL)
def funnel(t: Ledger) -> DataFrame:
    return review.funnel(t.sources, t.latest)


@query("SELECT coalesce(stage, 'unknown') AS stage, count(*) AS screened, count(*) FILTER (verdict = 'exclude') AS excluded, count(*) FILTER (verdict = 'include') AS included FROM p1 GROUP BY 1")
def funnel_by_stage(t: Ledger) -> DataFrame:
    return review.funnel_by_stage(t.latest)


@query("SELECT reason, count(*) AS n FROM p1 WHERE verdict = 'exclude' AND reason <> '' GROUP BY 1")
def exclusions_by_reason(t: Ledger) -> DataFrame:
    return review.exclusions(t.latest)


@query("SELECT coalesce(kind, 'unknown') AS kind, count(*) AS n FROM sources GROUP BY 1", False)
def sources_by_kind(t: Ledger) -> DataFrame:
    return review.histogram(t.sources, F.col("kind"), "kind")


@query("SELECT coalesce(CAST(year AS VARCHAR), 'unknown') AS year, count(*) AS n FROM sources GROUP BY 1", False)
def sources_by_year(t: Ledger) -> DataFrame:
    return review.histogram(t.sources, F.col("year"), "year")


@query("SELECT coalesce(interest_disclosure, 'unclear') AS interest, count(*) AS n FROM sources GROUP BY 1", False)
def sources_by_interest(t: Ledger) -> DataFrame:
    return review.histogram(t.sources, F.col("interest_disclosure"), "interest", "unclear")


@query("SELECT count(*) AS total, count(*) FILTER (score >= 7) AS citable_7plus, count(*) FILTER (score = 6) AS context_6, count(*) FILTER (score < 6) AS below_threshold, count(*) FILTER (quote <> '') AS with_quote, count(DISTINCT question) AS questions_covered FROM ev")
def evidence_stats(t: Ledger) -> DataFrame:
    s = F.col("score")
    return t.ev.agg(F.count(F.lit(1)).alias("total"), F.count_if(s >= vocab.CITE_SCORE).alias("citable_7plus"), F.count_if(s == vocab.KEEP_SCORE).alias("context_6"), F.count_if(s < vocab.KEEP_SCORE).alias("below_threshold"), F.count_if(present(F.col("quote"))).alias("with_quote"), F.countDistinct("question").alias("questions_covered"))


@query("""SELECT count(*) AS cells, count(DISTINCT "column") AS columns, count(*) FILTER (quote <> '') AS cells_with_quote, count(*) FILTER (lower(value) = 'not reported') AS not_reported FROM (SELECT source, "column", arg_max(value, seq) AS value, max_by(coalesce(quote, ''), seq) AS quote FROM extraction GROUP BY 1, 2)""")
def extraction_stats(t: Ledger) -> DataFrame:
    return latest_cells(t).agg(F.count(F.lit(1)).alias("cells"), F.countDistinct("column").alias("columns"), F.count_if(present(F.col("quote"))).alias("cells_with_quote"), F.count_if(F.lower("value") == "not reported").alias("not_reported"))


def latest_cells(t: Ledger) -> DataFrame:
    """Extraction cells after upsert by (source, column): the last of the log."""
    return t.extraction.groupBy("source", "column").agg(F.max_by(F.struct("value", F.coalesce("quote", F.lit("")).alias("quote"), F.coalesce("locator", F.lit("")).alias("locator"), "seq"), "seq").alias("x")).select("source", "column", "x.*")


@query("""SELECT source, "column", arg_max(value, seq) AS value, max(seq) AS seq FROM extraction GROUP BY 1, 2""")
def extract_upsert(t: Ledger) -> DataFrame:
    return latest_cells(t).select("source", "column", "value", "seq")


@query("SELECT consensus, count(id) AS n FROM (SELECT unnest(['strong', 'moderate', 'contested', 'thin', 'absent']) AS consensus) LEFT JOIN claims USING (consensus) GROUP BY 1")
def claims_by_consensus(t: Ledger) -> DataFrame:
    return review.dense_histogram(t.claims, "consensus", vocab.CONSENSUS)


@query("SELECT class, count(a) AS n FROM (SELECT unnest(['direct', 'scope', 'methodological', 'version-drift', 'interpretive']) AS class) LEFT JOIN contradictions USING (class) GROUP BY 1")
def contradictions_by_class(t: Ledger) -> DataFrame:
    return review.dense_histogram(t.contradictions, "class", vocab.CONTRADICTION_CLASSES)


@query("SELECT status, count(id) AS n FROM (SELECT unnest(['supported', 'partial', 'unsupported', 'contradicted']) AS status) LEFT JOIN verification USING (status) GROUP BY 1")
def verification_by_status(t: Ledger) -> DataFrame:
    return review.dense_histogram(t.verification, "status", vocab.VERIFY_STATUS)


@query("SELECT (SELECT count(*) FROM verification) AS questions, (SELECT count(DISTINCT claim) FROM verification) AS claims_verified, (SELECT count(*) FROM claims WHERE id NOT IN (SELECT claim FROM verification)) AS claims_unverified")
def verification_cover(t: Ledger) -> DataFrame:
    v = t.verification.agg(F.count(F.lit(1)).alias("questions"), F.countDistinct("claim").alias("claims_verified"))
    c = t.claims.join(t.verification.select(F.col("claim").alias("id")), "id", "left_anti").agg(F.count(F.lit(1)).alias("claims_unverified"))
    return v.crossJoin(c)


@query("SELECT claim, count(DISTINCT source) AS sources, count(*) AS records, min(score) AS lowest FROM cs GROUP BY 1")
def claim_source_count(t: Ledger) -> DataFrame:
    return claim_support_rows(t).groupBy("claim").agg(F.countDistinct("source").alias("sources"), F.count(F.lit(1)).alias("records"), F.min("score").alias("lowest"))


def claim_support_rows(t: Ledger) -> DataFrame:
    """Claims, exploded, joined to the evidence they cite: ``(claim, consensus, eid, score, source)``."""
    ids = t.claims.select(F.col("id").alias("claim"), "consensus", F.explode("evidence").alias("eid"))
    return ids.join(t.ev.select(F.col("id").alias("eid"), "score", "source", "summary", "from_scope"), "eid")


@query("SELECT cs.claim, cs.eid, cs.source, s.id IS NOT NULL AS known, s.read_at IS NOT NULL AS is_read, i.id IS NOT NULL AS is_included FROM cs LEFT JOIN sources s ON s.id = cs.source LEFT JOIN inc i ON i.id = cs.source")
def claim_support(t: Ledger) -> DataFrame:
    s = t.sources.select(F.col("id").alias("source"), "read_at", F.lit(True).alias("k"))
    i = t.included.select(F.col("id").alias("source"), F.lit(True).alias("i"))
    rows = claim_support_rows(t).join(s, "source", "left").join(i, "source", "left")
    return rows.select("claim", "eid", "source", F.col("k").isNotNull().alias("known"), F.col("read_at").isNotNull().alias("is_read"), F.col("i").isNotNull().alias("is_included"))


@query("SELECT id, metadata_at <> '' AND read_at IS NULL AS metadata_only, read_at IS NOT NULL AS read, read_at IS NOT NULL AND coalesce(read_scope, '') <> 'abstract' AS read_fulltext, coalesce(metadata_at, '') = '' AS unfetched FROM (SELECT id, coalesce(metadata_at, '') AS metadata_at, read_at, read_scope FROM sources)", False)
def read_state(t: Ledger) -> DataFrame:
    read, met = F.col("read_at").isNotNull(), F.coalesce("metadata_at", F.lit("")) != ""
    return t.sources.select("id", (met & ~read).alias("metadata_only"), read.alias("read"), (read & (F.coalesce("read_scope", F.lit("")) != "abstract")).alias("read_fulltext"), (~met).alias("unfetched"))


@query("SELECT question, count(DISTINCT source) AS sources, max(score) AS best, CASE WHEN count(*) FILTER (score >= 7) = 0 THEN 'empty' WHEN count(DISTINCT source) FILTER (score >= 7) >= 3 THEN 'solid' ELSE 'thin' END AS state FROM ev WHERE question IS NOT NULL GROUP BY 1")
def sufficiency(t: Ledger) -> DataFrame:
    good = F.when(F.col("score") >= vocab.CITE_SCORE, F.col("source"))
    g = t.ev.filter("question is not null").groupBy("question").agg(F.countDistinct("source").alias("sources"), F.max("score").alias("best"), F.countDistinct(good).alias("g"), F.count_if(F.col("score") >= vocab.CITE_SCORE).alias("n"))
    return g.select("question", "sources", "best", F.when(F.col("n") == 0, "empty").when(F.col("g") >= 3, "solid").otherwise("thin").alias("state"))


@query("SELECT d AS round, count(*) AS seen, count(*) FILTER (d = s) AS novel, round(count(*) FILTER (d = s) / count(*), 6) AS ratio FROM (SELECT source, d, min(d) OVER (PARTITION BY source) AS s FROM (SELECT DISTINCT source, CAST(CAST(at_time AS DATE) AS VARCHAR) AS d FROM screening WHERE source IS NOT NULL AND at_time IS NOT NULL)) GROUP BY 1", False)
def saturation(t: Ledger) -> DataFrame:
    return review.saturation(t.screening, F.col("source"), F.to_date("at_time").cast("string"))


@query("SELECT source, count(*) AS queries, count(*) FILTER (hits = 0 OR hits IS NULL) AS empty_queries, CAST(sum(coalesce(hits, 0)) AS BIGINT) AS hits, CAST(sum(coalesce(kept, 0)) AS BIGINT) AS kept, round(sum(coalesce(kept, 0)) / nullif(sum(coalesce(hits, 0)), 0), 6) AS keep_rate FROM queries GROUP BY 1", False)
def keep_rate(t: Ledger) -> DataFrame:
    h, k = F.coalesce("hits", F.lit(0)), F.coalesce("kept", F.lit(0))
    return t.queries.groupBy("source").agg(F.count(F.lit(1)).alias("queries"), F.count_if(h == 0).alias("empty_queries"), F.sum(h).alias("hits"), F.sum(k).alias("kept"), F.round(F.try_divide(F.sum(k), F.sum(h)), 6).alias("keep_rate"))


@query("SELECT coalesce(lang, 'unknown') AS lang, source, count(*) AS n, CAST(sum(hits) AS BIGINT) AS hits, count(*) FILTER (hits = 0) AS zero_hits FROM queries GROUP BY 1, 2", False)
def query_coverage(t: Ledger) -> DataFrame:
    return t.queries.groupBy(F.coalesce("lang", F.lit("unknown")).alias("lang"), "source").agg(F.count(F.lit(1)).alias("n"), F.sum("hits").alias("hits"), F.count_if(F.col("hits") == 0).alias("zero_hits"))


@query("SELECT reviewer, max(n) AS longest FROM (SELECT reviewer, g, count(*) AS n FROM (SELECT reviewer, x, row_number() OVER w - sum(CASE WHEN x THEN 1 ELSE 0 END) OVER w AS g FROM (SELECT reviewer, seq, coalesce(lower(regexp_replace(verdict, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) = 'exclude', false) AS x FROM screening WHERE reviewer IS NOT NULL AND seq IS NOT NULL) WINDOW w AS (PARTITION BY reviewer ORDER BY seq, x ROWS UNBOUNDED PRECEDING)) WHERE x GROUP BY 1, 2) GROUP BY 1", False)
def exclude_streak(t: Ledger) -> DataFrame:
    return review.exclude_streaks(t.screening)


@query("SELECT coalesce(interest_disclosure, 'unclear') AS interest, coalesce(kind, 'unknown') AS kind, count(*) AS n FROM sources GROUP BY 1, 2", False)
def interest_crosstab(t: Ledger) -> DataFrame:
    """Sources by interest and kind, whatever kinds there are."""
    return t.sources.groupBy(F.coalesce("interest_disclosure", F.lit("unclear")).alias("interest"), F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT "column", count(*) AS cells, round(count(*) FILTER (lower(value) = 'not reported') / count(*), 6) AS rate FROM (SELECT source, "column", arg_max(value, seq) AS value FROM extraction GROUP BY 1, 2) GROUP BY 1""")
def not_reported_rate(t: Ledger) -> DataFrame:
    return latest_cells(t).groupBy("column").agg(F.count(F.lit(1)).alias("cells"), F.round(F.count_if(F.lower("value") == "not reported") / F.count(F.lit(1)), 6).alias("rate"))


@query("SELECT CASE WHEN score >= 9 THEN '9-10' WHEN score >= 7 THEN '7-8' WHEN score >= 5 THEN '5-6' WHEN score >= 3 THEN '3-4' WHEN score >= 1 THEN '1-2' ELSE 'out of range' END AS band, count(*) AS n FROM ev WHERE score <= 10 GROUP BY 1")
def score_bands(t: Ledger) -> DataFrame:
    s = F.col("score")
    band = F.when(s >= 9, "9-10").when(s >= 7, "7-8").when(s >= 5, "5-6").when(s >= 3, "3-4").when(s >= 1, "1-2").otherwise("out of range")
    return t.ev.filter(s <= 10).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS sources, count(*) FILTER (interest_disclosure IN ('vendor', 'sponsored')) AS interested, round(count(*) FILTER (interest_disclosure IN ('vendor', 'sponsored')) / nullif(count(*), 0), 6) AS share FROM sources WHERE id IN (SELECT id FROM inc)")
def vendor_share(t: Ledger) -> DataFrame:
    s = t.sources.join(t.included, "id", "left_semi")
    n = F.count_if(F.col("interest_disclosure").isin("vendor", "sponsored"))
    return s.agg(F.count(F.lit(1)).alias("sources"), n.alias("interested"), F.round(F.try_divide(n, F.count(F.lit(1))), 6).alias("share"))


@query("SELECT (SELECT count(*) FROM claims) AS claims, (SELECT count(DISTINCT ce.claim) FROM ce WHERE eid IN (SELECT a FROM contradictions UNION SELECT b FROM contradictions)) AS contradicted, round((SELECT count(DISTINCT ce.claim) FROM ce WHERE eid IN (SELECT a FROM contradictions UNION SELECT b FROM contradictions)) / (SELECT nullif(count(*), 0) FROM claims), 6) AS share")
def contradiction_share(t: Ledger) -> DataFrame:
    sides = t.contradictions.select(F.explode(F.array("a", "b")).alias("eid")).distinct()
    hit = t.claims.select("id", F.explode_outer("evidence").alias("eid")).join(sides.withColumn("h", F.lit(1)), "eid", "left")
    one = hit.agg(F.countDistinct("id").alias("claims"), F.countDistinct(F.when(F.col("h") == 1, F.col("id"))).alias("contradicted"))
    return one.withColumn("share", F.round(F.try_divide("contradicted", "claims"), 6))


@query(f"SELECT id, year FROM sources WHERE year < {AS_OF_YEAR} - 5", False)
def outside_window(t: Ledger) -> DataFrame:
    return t.sources.filter(F.col("year") < AS_OF_YEAR - 5).select("id", "year")


@query(f"SELECT question, max(s.year) AS newest FROM ev JOIN sources s ON s.id = ev.source WHERE question IS NOT NULL AND s.year <= {AS_OF_YEAR} GROUP BY 1 HAVING max(s.year) < {AS_OF_YEAR} - 3")
def temporal_gap(t: Ledger) -> DataFrame:
    """Questions whose newest source (of a year that isn't to come) is more than three years old."""
    j = t.ev.filter("question is not null").join(t.sources.select(F.col("id").alias("source"), "year"), "source").filter(F.col("year") <= AS_OF_YEAR)
    return j.groupBy("question").agg(F.max("year").alias("newest")).filter(F.col("newest") < AS_OF_YEAR - vocab.STALE_YEARS)




@query("SELECT key, n FROM (SELECT unnest(map_entries(MAP {'identified': identified, 'read': read, 'read_fulltext': read_fulltext, 'screened': screened, 'excluded': excluded, 'included': included, 'evidence': (SELECT count(*) FROM ev), 'evidence_citable': (SELECT count(*) FILTER (score >= 7) FROM ev), 'claims': (SELECT count(*) FROM claims), 'contradictions': (SELECT count(*) FROM contradictions), 'verification': (SELECT count(*) FROM verification)}), recursive := true) FROM (" + _FUNNEL + ")) t(key, n)")
def stats_payload(t: Ledger) -> DataFrame:
    f = review.funnel(t.sources, t.latest).select("identified", "read", "read_fulltext", "screened", "excluded", "included")
    e = t.ev.agg(F.count(F.lit(1)).alias("evidence"), F.count_if(F.col("score") >= vocab.CITE_SCORE).alias("evidence_citable"))
    one = f.crossJoin(e)
    for name in ("claims", "contradictions", "verification"):
        one = one.crossJoin(getattr(t, name).agg(F.count(F.lit(1)).alias(name)))  # one row each
    return one.unpivot([], one.columns, "key", "n")


@query("SELECT id, question, source, count(*) OVER (PARTITION BY question, source) - 1 AS partners FROM ev WHERE question IS NOT NULL AND source IS NOT NULL")
def contradiction_candidates(t: Ledger) -> DataFrame:
    """Records that may contradict others on the same question and source: one row each, with the number of partners, not all pairs."""
    rows = t.ev.filter("question is not null and source is not null").select("id", "question", "source")
    groups = rows.groupBy("question", "source").agg(F.count(F.lit(1)).alias("n"))
    return salted_lookup(rows, groups, ["question", "source"], "id", counted="n").select("id", "question", "source", (F.col("n") - 1).alias("partners"))


@query("SELECT 'S' || lpad(CAST((SELECT max(CAST(substr(id, 2) AS BIGINT)) FROM sources) + row_number() OVER (ORDER BY rec_id) AS VARCHAR), 9, '0') AS id, rec_id FROM recs WHERE rec_id NOT IN (SELECT rec_id FROM sources WHERE rec_id IS NOT NULL)", False)
def next_ids(t: Ledger) -> DataFrame:
    """New ids after the largest; numbered by partition offsets, so that no task sees all rows."""
    last = t.sources.agg(F.max(F.substring("id", 2, 12).cast("bigint")).alias("last"))
    new = t.recs.select("rec_id").join(t.sources.filter("rec_id is not null").select("rec_id"), "rec_id", "left_anti")


    numbered = global_row_number(new, [F.col("rec_id")], "rn").crossJoin(last)  # one row
    n = (F.coalesce("last", F.lit(0)) + F.col("rn")).cast("string")
    return numbered.select(F.concat(F.lit("S"), F.lpad(n, 9, "0")).alias("id"), "rec_id")
