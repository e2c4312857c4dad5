"""Catalogue queries: normalisation, keys, filters, citations and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import identity
from ..functions.text import clean_abstract, from_inverted_index
from ..operators import catalogue, resolution
from .views import Ledger

THIS_YEAR = 2026
QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Ledger(spark, folder))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_DOI = r"nullif(lower(trim(regexp_replace(regexp_replace({0}, '^https?://(dx\.)?(doi\.org|resolver\.example)/', '', 'i'), '^doi:', '', 'i'))), '')"
_ARX = r"nullif(trim(regexp_replace(regexp_replace(regexp_replace({0}, '^https?://(arxiv\.org|preprints\.example)/abs/', '', 'i'), '^arxiv:', '', 'i'), 'v\d+$', '', 'i')), '')"
_SEG = r"CASE WHEN {0} <> '' THEN list_last(string_split(regexp_replace({0}, '/+$', ''), '/')) END"
_CLEAN = r"trim(regexp_replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
_TITLE = r"trim(regexp_replace(regexp_replace(strip_accents(lower(title)), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g'))"
_WORDS = "SELECT delivery_id, string_agg(k, ' ' ORDER BY p, k) AS abstract FROM (SELECT delivery_id, k, unnest(v) AS p FROM (SELECT delivery_id, e.key AS k, e.value AS v FROM (SELECT delivery_id, unnest(map_entries(abstract_inverted_index)) AS e FROM oa_works))) WHERE p IS NOT NULL GROUP BY 1"


@query(f"""SELECT delivery_id, coalesce(display_name, '') AS title, coalesce(list_filter(list_transform(authorships, lambda a: a.author.display_name), lambda x: x IS NOT NULL AND x <> ''), []) AS authors, publication_year AS year,
 primary_location.source.display_name AS venue, {_DOI.format('doi')} AS doi, {_SEG.format('ids.pmid')} AS pmid, {_SEG.format('ids.pmcid')} AS pmcid, nullif(regexp_extract({_DOI.format('doi')}, '^10\\.48550/arxiv\\.(.+)$', 1), '') AS arxiv, {_SEG.format('id')} AS openalex,
 coalesce(primary_location.landing_page_url, doi) AS url, coalesce(best_oa_location.pdf_url, open_access.oa_url) AS oa_url, abstract, cited_by_count AS citations, coalesce(work_type, 'unknown') AS kind, is_retracted AS retracted, lang,
 primary_topic.display_name AS topic, coalesce(list_filter(list_transform(referenced_works, lambda x: {_SEG.format('x')}), lambda x: x IS NOT NULL AND x <> ''), []) AS referenced_works FROM oa_works LEFT JOIN ({_WORDS}) USING (delivery_id)""")
def norm_openalex(t: Ledger) -> DataFrame:
    return catalogue.from_nested(t.oa_works)


@query(_WORDS)
def inverted_index(t: Ledger) -> DataFrame:
    return t.oa_works.select("delivery_id", from_inverted_index(F.col("abstract_inverted_index")).alias("abstract")).filter("abstract is not null")


@query(f"SELECT rec_id, coalesce(title, '') AS title, coalesce(list_filter(authors, lambda x: x IS NOT NULL AND x <> ''), []) AS authors, year, venue, {_DOI.format('doi')} AS doi, {_ARX.format('arxiv')} AS arxiv, pmid, CAST(rec_id * 7 AS VARCHAR) AS corpus_id, coalesce(kind, 'unknown') AS kind, citations FROM recs")
def norm_s2(t: Ledger) -> DataFrame:
    """The payload with external ids is rebuilt from the records first."""
    ids = F.struct(F.col("doi").alias("DOI"), F.col("arxiv").alias("ArXiv"), F.col("pmid").alias("PubMed"), (F.col("rec_id") * 7).alias("CorpusId"))
    papers = t.recs.select("rec_id", "title", "venue", "year", F.col("citations").alias("citationCount"), ids.alias("externalIds"), F.transform("authors", lambda a: F.struct(a.alias("name"))).alias("authors"), F.array("kind").alias("publicationTypes"))
    return catalogue.from_external_ids(papers)


@query(f"SELECT rec_id, coalesce(title, '') AS title, coalesce(list_filter(list_transform(authors, lambda a: trim(concat_ws(' ', substr(a, 1, 2), substr(a, 4)))), lambda x: x IS NOT NULL AND x <> ''), []) AS authors, year, venue, {_DOI.format('doi')} AS doi, {_CLEAN.format('abstract')} AS abstract, coalesce(list_filter(list_transform(referenced_works, lambda x: {_DOI.format('x')}), lambda x: x IS NOT NULL), []) AS referenced_works FROM recs")
def norm_crossref(t: Ledger) -> DataFrame:
    person = lambda a: F.struct(F.substring(a, 1, 2).alias("given"), F.substring(a, 4, 1000).alias("family"))
    works = t.recs.select("rec_id", F.array("title").alias("title"), F.array("venue").alias("container_title"), F.array(F.array("year")).alias("date_parts"), F.transform("authors", person).alias("author"), F.col("doi").alias("DOI"), "abstract", F.transform("referenced_works", lambda r: F.struct(r.alias("DOI"))).alias("reference"))
    return catalogue.from_registry(works)


@query(f"SELECT rec_id, coalesce(title, '') AS title, CASE WHEN authors IS NULL THEN [] ELSE list_filter(list_transform(string_split(regexp_replace(array_to_string(authors, ', ') || '.', '\\.$', ''), ','), lambda x: trim(x)), lambda x: x <> '') END AS authors, year, venue, {_DOI.format('doi')} AS doi, CASE WHEN rec_id % 3 = 0 THEN 'pmc:' || pmcid END AS oa_url, {_CLEAN.format('abstract')} AS abstract FROM recs")
def norm_epmc(t: Ledger) -> DataFrame:
    results = t.recs.select("rec_id", "title", F.when(F.col("authors").isNotNull(), F.concat(F.array_join("authors", ", "), F.lit("."))).alias("authorString"), F.col("year").cast("string").alias("pubYear"), F.col("venue").alias("journalTitle"), "doi", "pmcid", F.when(F.col("rec_id") % 3 == 0, "Y").otherwise("N").alias("inEPMC"), F.col("abstract").alias("abstractText"))
    return catalogue.from_flat(results)


@query(f"SELECT rec_id, {_CLEAN.format('abstract')} AS abstract FROM recs WHERE abstract IS NOT NULL")
def abstract_clean(t: Ledger) -> DataFrame:
    return t.recs.filter("abstract is not null").select("rec_id", clean_abstract(F.col("abstract")).alias("abstract"))


@query(f"SELECT rec_id, {_DOI.format('doi')} AS doi, {_ARX.format('arxiv')} AS arxiv FROM recs")
def clean_ids(t: Ledger) -> DataFrame:
    return t.recs.select("rec_id", identity.clean_doi(F.col("doi")).alias("doi"), identity.clean_arxiv(F.col("arxiv")).alias("arxiv"))


@query(f"SELECT rec_id, CASE WHEN length(t) > 15 THEN t || '|' || coalesce(CAST(year AS VARCHAR), '?') END AS key FROM (SELECT rec_id, year, {_TITLE} AS t FROM recs)")
def title_key(t: Ledger) -> DataFrame:
    return t.recs.select("rec_id", identity.title_key(F.col("title"), F.col("year")).alias("key"))


@query(r"SELECT rec_id, CASE WHEN length(t) > 15 THEN t || '|' || coalesce(CAST(year AS VARCHAR), '?') END AS title_key, lower(regexp_replace(url, '(?s)[#?].*$', '')) AS url_key FROM (SELECT rec_id, year, url, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM recs)")
def ledger_keys(t: Ledger) -> DataFrame:
    return t.recs.select("rec_id", identity.ledger_title_key(F.col("title"), F.col("year")).alias("title_key"), identity.url_key(F.col("url")).alias("url_key"))


_URL = r"""lower(CASE WHEN regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) = '' THEN trim(url) ELSE regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1)
 || regexp_replace(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/+$', '')
 || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END END)"""
_PS = r"list_filter(string_split(regexp_extract(trim(url), '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_|ref|source|fbclid|gclid)')) AS ps"


@query(f"SELECT rec_id, {_URL} AS url FROM (SELECT rec_id, url, {_PS} FROM (SELECT rec_id, url || CASE rec_id % 4 WHEN 0 THEN '/?utm_source=x&page=2&ref=7' WHEN 1 THEN '#top' WHEN 2 THEN '?gclid=1' ELSE '//' END AS url FROM recs WHERE url IS NOT NULL))")
def norm_url(t: Ledger) -> DataFrame:
    k = F.col("rec_id") % 4
    tail = F.when(k == 0, "/?utm_source=x&page=2&ref=7").when(k == 1, "#top").when(k == 2, "?gclid=1").otherwise("//")
    return t.recs.filter("url is not null").select("rec_id", identity.normal_url(F.concat("url", tail)).alias("url"))


@query(rf"""SELECT rec_id, coalesce(CASE WHEN doi <> '' THEN 'doi-' || substr(sha1(lower(trim(regexp_replace(regexp_replace(doi, '^https?://(dx\.)?(doi\.org|resolver\.example)/', '', 'i'), '^doi:', '', 'i')))), 1, 12) END,
 CASE WHEN pmcid <> '' THEN 'pmcid-' || substr(sha1(upper(trim(pmcid))), 1, 12) END, CASE WHEN pmid <> '' THEN 'pmid-' || substr(sha1(trim(pmid)), 1, 12) END,
 CASE WHEN arxiv <> '' THEN 'arxiv-' || substr(sha1(lower(trim(regexp_replace(arxiv, 'v\d+$', '', 'i')))), 1, 12) END, CASE WHEN openalex <> '' THEN 'oa-' || substr(sha1(upper(trim(openalex))), 1, 12) END,
 CASE WHEN url <> '' THEN 'url-' || substr(sha1({_URL}), 1, 12) END, CASE WHEN length(tt) >= 12 THEN 'title-' || substr(sha1(tt || '|' || coalesce(CAST(year AS VARCHAR), '')), 1, 12) END) AS key
 FROM (SELECT *, {_PS}, trim(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS tt FROM recs)""")
def cache_key(t: Ledger) -> DataFrame:
    return t.recs.select("rec_id", identity.cache_key(*[F.col(c) for c in ("doi", "pmcid", "pmid", "arxiv", "openalex", "url", "title", "year")]).alias("key"))


@query(r"SELECT rec_id, v AS identifier, CASE WHEN regexp_matches(trim(v), '(?i)^W\d+$') THEN 'openalex' WHEN regexp_matches(" + _DOI.format("trim(v)") + r", '^10\.\d{4,}/') THEN 'doi' WHEN regexp_matches(trim(v), '^\d{7,8}$') THEN 'pmid' WHEN regexp_matches(" + _ARX.format("trim(v)") + r", '^\d{4}\.\d{4,5}') THEN 'arxiv' ELSE 'unrecognised' END AS route FROM (SELECT rec_id, unnest([doi, pmid, arxiv, openalex]) AS v FROM recs) WHERE v IS NOT NULL")
def resolve_route(t: Ledger) -> DataFrame:
    ids = t.recs.select("rec_id", F.explode(F.array("doi", "pmid", "arxiv", "openalex")).alias("identifier")).filter("identifier is not null")
    return ids.withColumn("route", identity.route(F.col("identifier")))


@query("SELECT rec_id, venue FROM recs WHERE NOT coalesce(regexp_matches(lower(venue), '" + "|".join(v.replace(".", r"\.") for v in vocab.PREPRINT_VENUES) + "'), false) AND coalesce(kind, '') <> 'preprint'")
def peer_reviewed_filter(t: Ledger) -> DataFrame:
    return t.recs.filter(~catalogue.is_preprint(F.col("venue")) & (F.coalesce("kind", F.lit("")) != "preprint")).select("rec_id", "venue")


@query("SELECT count(*) AS rows, count(*) FILTER (kind = 'preprint' OR coalesce(regexp_matches(lower(venue), '" + "|".join(v.replace(".", r"\.") for v in vocab.PREPRINT_VENUES) + "'), false)) AS dropped FROM recs")
def tier_dropped(t: Ledger) -> DataFrame:
    return t.recs.agg(F.count(F.lit(1)).alias("rows"), F.count_if((F.coalesce("kind", F.lit("")) == "preprint") | catalogue.is_preprint(F.col("venue"))).alias("dropped"))


@query(f"""SELECT rec_id, array_to_string(list_filter([CASE WHEN coalesce(title, '') = '' THEN 'no-title' END, CASE WHEN coalesce(len(authors), 0) = 0 THEN 'no-authors' END,
 CASE WHEN coalesce(doi, '') = '' AND coalesce(url, '') = '' AND coalesce(oa_url, '') = '' THEN 'no-locator' END, CASE WHEN retracted THEN 'RETRACTED' END, CASE WHEN year > {THIS_YEAR + 1} THEN 'implausible-year:' || year END,
 CASE WHEN (year >= {THIS_YEAR} AND citations > 300) OR (year = {THIS_YEAR - 1} AND citations > 2000) THEN 'citations-year-mismatch:' || citations || '@' || year END], lambda x: x IS NOT NULL), ',') AS flags FROM recs""")
def anomaly_flags(t: Ledger) -> DataFrame:
    return t.recs.select("rec_id", F.array_join(catalogue.anomalies(THIS_YEAR), ",").alias("flags"))


#: Searches with different options: name, arguments of the predicate, the same in SQL.
_OPEN = "coalesce(oa_url, '') <> ''"
_REVIEWED = "NOT coalesce(regexp_matches(lower(venue), '" + "|".join(v.replace(".", r"\.") for v in vocab.PREPRINT_VENUES) + "'), false) AND coalesce(kind, '') <> 'preprint'"
_SEARCHES = (
    ("all", {}, "true"),
    ("both", {"first": 2015, "last": 2022, "kinds": ("article", "review"), "open_access": True}, f"year BETWEEN 2015 AND 2022 AND kind IN ('article', 'review') AND {_OPEN}"),
    ("lower", {"first": 2018, "peer_reviewed": True}, f"year >= 2018 AND {_REVIEWED}"),
    ("upper", {"last": 2012, "words": "The training"}, "year <= 2012 AND (contains(lower(coalesce(title, '')), 'the') OR contains(lower(coalesce(abstract, '')), 'the')) AND (contains(lower(coalesce(title, '')), 'training') OR contains(lower(coalesce(abstract, '')), 'training'))"),
)


@query(" UNION ALL ".join(f"SELECT '{n}' AS search, rec_id, title, year, kind FROM recs WHERE coalesce(retracted, false) = false AND {w}" for n, _, w in _SEARCHES))
def filter_works(t: Ledger) -> DataFrame:
    """The records that searches with different options find, in one pass over them."""
    hits = F.array_compact(F.array(*[F.when(catalogue.works_predicate(**o), F.lit(n)) for n, o, _ in _SEARCHES]))
    return t.recs.select(F.explode(hits).alias("search"), "rec_id", "title", "year", "kind")


@query("SELECT CAST(year AS VARCHAR) AS key, count(*) AS n, (SELECT count(*) FROM recs) AS total FROM recs WHERE year IS NOT NULL GROUP BY 1 ORDER BY n DESC, key LIMIT 60")
def trend(t: Ledger) -> DataFrame:
    return catalogue.trend(t.recs, "year")


_EDGE = f"SELECT DISTINCT {_SEG.format('id')} AS citing, {_SEG.format('r')} AS cited FROM (SELECT id, unnest(referenced_works) AS r FROM oa_works) WHERE id <> '' AND r <> ''"


@query(f"SELECT cited AS work, count(*) AS citing_works FROM ({_EDGE}) GROUP BY 1")
def cites_forward(t: Ledger) -> DataFrame:
    return catalogue.citing_edges(t.oa_works).groupBy(F.col("cited").alias("work")).agg(F.count(F.lit(1)).alias("citing_works"))


@query(f"SELECT citing, cited, w IS NOT NULL AS known FROM ({_EDGE}) LEFT JOIN (SELECT DISTINCT {_SEG.format('id')} AS w FROM oa_works WHERE id <> '') ON w = cited")
def cites_backward(t: Ledger) -> DataFrame:
    known = t.oa_works.select(catalogue._last_segment(F.col("id")).alias("cited"), F.lit(True).alias("k")).filter("cited is not null").distinct()
    return catalogue.citing_edges(t.oa_works).join(known, "cited", "left").select("citing", "cited", F.col("k").isNotNull().alias("known"))


@query(f"SELECT a.citing AS seed, count(DISTINCT b.cited) AS second_generation FROM ({_EDGE}) a JOIN ({_EDGE}) b ON b.citing = a.cited GROUP BY 1")
def snowball(t: Ledger) -> DataFrame:
    """Two generations of references: works reached through the works a seed cites."""
    e = catalogue.citing_edges(t.oa_works)
    two = e.select(F.col("citing").alias("seed"), F.col("cited").alias("via")).join(e.select(F.col("citing").alias("via"), "cited"), "via")
    return two.groupBy("seed").agg(F.countDistinct("cited").alias("second_generation"))


@query(f"WITH w AS (SELECT * FROM oa_works WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY received_at DESC NULLS LAST, delivery_id DESC) = 1), top AS (SELECT {_SEG.format('id')} AS seed FROM w ORDER BY coalesce(cited_by_count, 0) DESC, id LIMIT 5) SELECT count(*) AS refs, count(*) FILTER (known) AS known, round(count(*) FILTER (known) / nullif(count(*), 0), 6) AS share FROM (SELECT cited IN (SELECT {_SEG.format('id')} FROM oa_works WHERE id <> '') AS known FROM ({_EDGE}) WHERE citing IN (SELECT seed FROM top))")
def snowball_closure(t: Ledger) -> DataFrame:
    """How much of what the five most cited works cite is already known."""
    top = catalogue.one_per_work(t.oa_works).orderBy(F.desc(F.coalesce("cited_by_count", F.lit(0))), "id").limit(5)
    refs = cites_backward(t).join(F.broadcast(top.select(catalogue._last_segment(F.col("id")).alias("citing"))), "citing", "left_semi")
    return refs.agg(F.count(F.lit(1)).alias("refs"), F.count_if("known").alias("known"), F.round(F.try_divide(F.count_if("known"), F.count(F.lit(1))), 6).alias("share"))


@query(f"""SELECT rec_id, key FROM (SELECT rec_id, unnest(list_distinct(list_filter(['doi:' || {_DOI.format('doi')}, 'pmid:' || nullif(trim(pmid), ''), 'pmcid:' || nullif(trim(pmcid), ''), 'arxiv:' || {_ARX.format('arxiv')}, 'oa:' || nullif(trim(openalex), ''), 's2:' || nullif(trim(corpus_id), ''),
 'title:' || CASE WHEN length(t) > 15 THEN t || '|' || coalesce(CAST(year AS VARCHAR), '?') END], lambda x: x IS NOT NULL))) AS key FROM (SELECT *, {_TITLE} AS t FROM recs))""")
def dedup_keys(t: Ledger) -> DataFrame:
    return catalogue.match_keys(t.recs)


_GROUP = f"SELECT rec_id, min(rec_id) OVER (PARTITION BY CASE WHEN length(t) > 15 THEN t || '|' || coalesce(CAST(year AS VARCHAR), '?') ELSE 'r' || rec_id END) AS g FROM (SELECT rec_id, year, {_TITLE} AS t FROM recs)"


@query(f"""SELECT g AS group_id, count(*) AS rows, arg_min(title, rec_id) FILTER (title <> '') AS title, arg_min(venue, rec_id) FILTER (venue <> '') AS venue, arg_min(year, rec_id) FILTER (year IS NOT NULL) AS year, arg_min(doi, rec_id) FILTER (doi <> '') AS doi,
 coalesce(max(len(authors)), 0) AS n_authors, nullif(greatest(max(coalesce(citations, 0)), 0), 0) AS citations, len(list_distinct(flatten(list(coalesce(found_by, []))))) AS n_queries FROM recs JOIN ({_GROUP}) USING (rec_id) GROUP BY 1""")
def dedup_merge(t: Ledger) -> DataFrame:
    """Records with the same title key merged field by field."""
    k = t.recs.withColumn("k", F.coalesce(identity.title_key(F.col("title"), F.col("year")), F.concat(F.lit("r"), F.col("rec_id").cast("string"))))
    m = catalogue.merged(k, "k")
    ids = k.groupBy("k").agg(F.min("rec_id").alias("group_id"))
    return m.join(ids, "k").select("group_id", "rows", "title", "venue", "year", "doi", F.greatest(F.coalesce(F.size("authors"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_authors"), "citations", F.size("found_by").cast("bigint").alias("n_queries"))


@query("SELECT rec_id, coalesce(citations, 0) AS citations, row_number() OVER (ORDER BY coalesce(citations, 0) DESC, rec_id) AS place FROM recs")
def dedup_rank(t: Ledger) -> DataFrame:
    return catalogue.by_citations(t.recs.select("rec_id", F.coalesce("citations", F.lit(0)).alias("citations")))


@query("SELECT rec_id, coalesce(kind, 'unknown') AS kind, coalesce(source_api, 'manual') AS source_api, coalesce(year, try_cast(substr(metadata_at, 1, 4) AS INTEGER)) AS year, nullif(metadata_at, '') AS metadata_at, 'unclear' AS interest_disclosure, list_sort(list_distinct(list_filter(list_append(coalesce(found_by, []), q), lambda x: x <> ''))) AS found_by FROM recs")
def source_ingest(t: Ledger) -> DataFrame:
    by = F.array_sort(F.array_distinct(F.filter(F.concat(F.coalesce("found_by", F.array().cast("array<string>")), F.array("q")), lambda x: x.isNotNull() & (x != ""))))
    return t.recs.select("rec_id", F.coalesce("kind", F.lit("unknown")).alias("kind"), F.coalesce("source_api", F.lit("manual")).alias("source_api"), F.coalesce("year", F.expr("try_cast(substring(metadata_at, 1, 4) as int)")).alias("year"), F.nullif("metadata_at", F.lit("")).alias("metadata_at"), F.lit("unclear").alias("interest_disclosure"), by.alias("found_by"))


_KEYED = f"""(SELECT {{owner}}, CAST(i AS INTEGER) AS rank, key FROM (SELECT {{owner}}, generate_subscripts(ks, 1) - 1 AS i, unnest(ks) AS key FROM (SELECT {{owner}}, ['doi:' || {_DOI.format('doi')}, 'pmid:' || nullif(trim(pmid), ''), 'arxiv:' || {_ARX.format('arxiv')}, 'oa:' || nullif(trim(openalex), ''),
 'url:' || nullif(lower(regexp_replace(url, '(?s)[#?].*$', '')), ''), 'title:' || CASE WHEN length(lt) > 15 THEN lt || '|' || coalesce(CAST(year AS VARCHAR), '?') END] AS ks
 FROM (SELECT *, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) AS lt FROM {{rows}}))) WHERE regexp_matches(key, '{resolution.USABLE}'))"""
_LINKS = """e AS (SELECT k.rec_id AS a, m.low AS b FROM {keys} k JOIN (SELECT key, min(rec_id) AS low FROM {keys} GROUP BY 1 HAVING count(*) > 1) m USING (key) WHERE k.rec_id <> m.low),
 both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT rec_id AS id, rec_id AS low FROM {ids} UNION SELECT w.b, r.low FROM r JOIN both_ways w ON w.a = r.id WHERE r.low < w.b),
 g AS (SELECT id AS rec_id, min(low) AS group_id FROM r GROUP BY 1)"""
_RESOLVED = f"WITH RECURSIVE mk AS MATERIALIZED (SELECT * FROM ({ORACLES['dedup_keys']}) WHERE regexp_matches(key, '{resolution.USABLE}')), " + _LINKS.format(keys="mk", ids="recs")


@query(_RESOLVED + " SELECT rec_id, group_id FROM g")
def dedup_resolve(t: Ledger) -> DataFrame:
    """The entity of each record: the smallest record that it shares one of seven keys with, directly or through others."""
    return resolution.resolve(t.recs)


@query(_RESOLVED + """ SELECT group_id, count(*) AS rows, arg_min(title, rec_id) FILTER (title <> '') AS title, arg_min(venue, rec_id) FILTER (venue <> '') AS venue, arg_min(year, rec_id) FILTER (year IS NOT NULL) AS year, arg_min(doi, rec_id) FILTER (doi <> '') AS doi,
 coalesce(max(len(authors)), 0) AS n_authors, nullif(greatest(max(coalesce(citations, 0)), 0), 0) AS citations, len(list_distinct(flatten(list(coalesce(found_by, []))))) AS n_queries FROM recs JOIN g USING (rec_id) GROUP BY 1""")
def dedup_records(t: Ledger) -> DataFrame:
    """One merged record per entity."""
    m = catalogue.merged(t.recs.join(resolution.resolve(t.recs), "rec_id"), "group_id")
    return m.select("group_id", "rows", "title", "venue", "year", "doi", F.greatest(F.coalesce(F.size("authors"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_authors"), "citations", F.size("found_by").cast("bigint").alias("n_queries"))


_BY = "len(list_distinct(list_filter({0}, lambda x: x <> '')))"
_FIRSTS = "arg_min(year, rec_id) FILTER (year IS NOT NULL) AS year, arg_min(venue, rec_id) FILTER (venue <> '') AS venue, arg_min(doi, rec_id) FILTER (doi <> '') AS doi, flatten(list(coalesce(found_by, []))) AS fb"


@query(f"""WITH RECURSIVE held AS (SELECT s.id, s.title, s.year, r.doi, r.pmid, r.arxiv, r.openalex, r.url, r.venue, r.found_by FROM sources s LEFT JOIN recs r ON r.rec_id = s.rec_id),
 fresh AS (SELECT * FROM recs WHERE rec_id NOT IN (SELECT rec_id FROM sources WHERE rec_id IS NOT NULL)), nk AS MATERIALIZED {_KEYED.format(owner='rec_id', rows='fresh')},
 ix AS (SELECT key, max(id) AS id FROM {_KEYED.format(owner='id', rows='held')} GROUP BY 1), hit AS MATERIALIZED (SELECT rec_id, arg_min(ix.id, rank) AS id FROM nk JOIN ix USING (key) GROUP BY 1),
 lone AS MATERIALIZED (SELECT * FROM fresh WHERE rec_id NOT IN (SELECT rec_id FROM hit)), lk AS MATERIALIZED (SELECT DISTINCT rec_id, key FROM nk WHERE rec_id NOT IN (SELECT rec_id FROM hit)), {_LINKS.format(keys='lk', ids='lone')},
 m AS (SELECT hit.id, count(*) AS records, {_FIRSTS} FROM fresh JOIN hit USING (rec_id) GROUP BY 1), n AS (SELECT group_id, count(*) AS records, {_FIRSTS} FROM lone JOIN g USING (rec_id) GROUP BY 1)
 SELECT h.id, CASE WHEN m.id IS NULL THEN 'kept' ELSE 'merged' END AS action, coalesce(records, 0) AS records, coalesce(h.year, m.year) AS year, coalesce(nullif(h.venue, ''), m.venue) AS venue, coalesce(nullif(h.doi, ''), m.doi) AS doi, {_BY.format("list_concat(coalesce(h.found_by, []), coalesce(m.fb, []))")} AS n_queries FROM held h LEFT JOIN m USING (id)
 UNION ALL SELECT 'S' || lpad(CAST((SELECT max(CAST(substr(id, 2) AS BIGINT)) FROM sources) + row_number() OVER (ORDER BY group_id) AS VARCHAR), 9, '0'), 'added', records, year, venue, doi, {_BY.format("fb")} FROM n""")
def source_upsert(t: Ledger) -> DataFrame:
    """The ledger's sources after the records that none stands for came in: matched by key, filled and united, or added."""
    return resolution.upsert(t.sources, t.recs)


_CACHE = "(" + ORACLES["cache_key"] + ")"


@query(f"SELECT k.rec_id, k.key, coalesce(chars >= {vocab.MIN_CACHED_CHARS}, false) AS hit, chars FROM {_CACHE} k LEFT JOIN (SELECT key, max(cache_chars) AS chars FROM sources s JOIN {_CACHE} c ON c.rec_id = s.rec_id WHERE cache_chars > 0 AND key IS NOT NULL GROUP BY 1) x USING (key)")
def cache_hit(t: Ledger) -> DataFrame:
    """Each record's cache entry, found by its key: what was cached for any record with the same key counts, if it is long enough."""
    keys = t.recs.select("rec_id", identity.cache_key(*[F.col(c) for c in ("doi", "pmcid", "pmid", "arxiv", "openalex", "url", "title", "year")]).alias("key"))
    entries = t.sources.filter("cache_chars > 0").select("rec_id", F.col("cache_chars").alias("chars")).join(keys, "rec_id").select("key", "chars")
    return resolution.cache_lookup(keys, entries, vocab.MIN_CACHED_CHARS)


@query("SELECT id, read_at FROM sources WHERE read_at < (SELECT max(read_at) FROM sources) - INTERVAL 90 DAY")
def cache_prune(t: Ledger) -> DataFrame:
    last = t.sources.agg(F.max("read_at").alias("last"))
    return t.sources.crossJoin(F.broadcast(last)).filter("read_at < last - interval 90 days").select("id", "read_at")  # one row


@query("SELECT coalesce(read_scope, 'none') AS scope, CAST(sum(coalesce(cache_chars, 0)) AS BIGINT) AS bytes, count(*) AS entries FROM sources GROUP BY 1")
def cache_bytes(t: Ledger) -> DataFrame:
    return t.sources.groupBy(F.coalesce("read_scope", F.lit("none")).alias("scope")).agg(F.sum(F.coalesce("cache_chars", F.lit(0))).alias("bytes"), F.count(F.lit(1)).alias("entries"))


@query("SELECT rec_id, CASE WHEN length(abstract) >= 400 THEN 'abstract' WHEN length(tldr) >= 20 THEN 'tldr' WHEN length(title) >= 20 THEN 'title' ELSE 'none' END AS route, substr(CASE WHEN length(abstract) >= 400 THEN abstract WHEN length(tldr) >= 20 THEN tldr WHEN length(title) >= 20 THEN title END, 1, 400000) AS text FROM recs")
def fulltext_route(t: Ledger) -> DataFrame:
    """The first text that is long enough, and where it came from."""
    long = lambda c, n: F.when(F.length(c) >= n, F.col(c))
    a, b, c = long("abstract", 400), long("tldr", 20), long("title", 20)
    return t.recs.select("rec_id", F.when(a.isNotNull(), "abstract").when(b.isNotNull(), "tldr").when(c.isNotNull(), "title").otherwise("none").alias("route"), F.substring(F.coalesce(a, b, c), 1, vocab.MAX_TEXT_CHARS).alias("text"))


@query("SELECT outcome, count(h) AS n FROM (SELECT unnest(['ok', 'dead', 'blocked', 'unreachable', 'no-locator']) AS outcome) LEFT JOIN (SELECT rec_id AS h, CASE WHEN coalesce(url, '') = '' THEN 'no-locator' WHEN s BETWEEN 200 AND 399 THEN 'ok' WHEN s IN (401, 403, 429, 999) THEN 'blocked' WHEN s IN (404, 410) THEN 'dead' ELSE 'unreachable' END AS outcome FROM (SELECT rec_id, url, ([200, 301, 403, 404, 500, 999, 410, 0])[rec_id % 8 + 1] AS s FROM recs)) USING (outcome) GROUP BY 1")
def verify_tally(t: Ledger) -> DataFrame:
    from ..operators.review import dense_histogram

    status = F.element_at(F.array(*map(F.lit, (200, 301, 403, 404, 500, 999, 410, 0))), (F.col("rec_id") % 8 + 1).cast("int"))
    return dense_histogram(t.recs.select(locator_outcome(F.col("url"), status).alias("outcome")), "outcome", vocab.LOCATOR_OUTCOMES)


def locator_outcome(url, status):
    """What became of a locator, by the status of the answer (0: none)."""
    return F.when(F.coalesce(url, F.lit("")) == "", "no-locator").when(status.between(200, 399), "ok").when(status.isin(401, 403, 429, 999), "blocked").when(status.isin(404, 410), "dead").otherwise("unreachable")


@query("SELECT id, array_to_string(list_slice(authors, 1, 3), ', ') || CASE WHEN len(authors) > 3 THEN ' et al.' ELSE '' END || ' (' || coalesce(CAST(year AS VARCHAR), 'n.d.') || '). ' || coalesce(title, '') AS entry FROM sources WHERE authors IS NOT NULL")
def bibliography(t: Ledger) -> DataFrame:
    who = F.concat(F.array_join(F.slice("authors", 1, 3), ", "), F.when(F.size("authors") > 3, " et al.").otherwise(""))
    return t.sources.filter("authors is not null").select("id", F.concat(who, F.lit(" ("), F.coalesce(F.col("year").cast("string"), F.lit("n.d.")), F.lit("). "), F.coalesce("title", F.lit(""))).alias("entry"))
