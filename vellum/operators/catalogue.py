"""Catalogue records: normalisation from four payload shapes, matching keys, merging, ranking, citations and trends.

Missing means null or empty throughout; an empty payload gives a record of nulls and empty arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import vocab
from ..functions.identity import clean_arxiv, clean_doi, title_key
from ..functions.text import clean_abstract, from_inverted_index, present
from .ranking import global_row_number


def _last_segment(url: Column) -> Column:
    return F.when(present(url), F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1))


def _names(array: Column, get) -> Column:
    return F.coalesce(F.filter(F.transform(array, get), lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def from_nested(works: DataFrame) -> DataFrame:
    """Nested payloads (ids as URLs, inverted abstracts) as records; ``metadata_at`` is left to the caller."""
    doi = clean_doi(F.col("doi"))
    abstract = from_inverted_index(F.col("abstract_inverted_index"))
    arxiv = F.regexp_extract(doi, r"^10\.48550/arxiv\.(.+)$", 1)
    return works.select(
        "delivery_id", F.coalesce("display_name", F.lit("")).alias("title"), _names(F.col("authorships"), lambda a: a["author"]["display_name"]).alias("authors"),
        F.col("publication_year").alias("year"), F.col("primary_location.source.display_name").alias("venue"), doi.alias("doi"),
        _last_segment(F.col("ids.pmid")).alias("pmid"), _last_segment(F.col("ids.pmcid")).alias("pmcid"), F.nullif(arxiv, F.lit("")).alias("arxiv"), _last_segment(F.col("id")).alias("openalex"),
        F.coalesce("primary_location.landing_page_url", "doi").alias("url"), F.coalesce("best_oa_location.pdf_url", "open_access.oa_url").alias("oa_url"),
        abstract.alias("abstract"), F.col("cited_by_count").alias("citations"), F.coalesce("work_type", F.lit("unknown")).alias("kind"), F.col("is_retracted").alias("retracted"), "lang",
        F.col("primary_topic.display_name").alias("topic"), _names(F.col("referenced_works"), _last_segment).alias("referenced_works"),
    )


def from_external_ids(papers: DataFrame) -> DataFrame:
    """Payloads with an ``externalIds`` struct: ``(rec_id, title, authors, year, venue, doi, arxiv, pmid, corpus_id, kind, citations)``."""
    e = F.col("externalIds")
    return papers.select(
        "rec_id", F.coalesce("title", F.lit("")).alias("title"), _names(F.col("authors"), lambda a: a["name"]).alias("authors"), "year", "venue", clean_doi(e["DOI"]).alias("doi"), clean_arxiv(e["ArXiv"]).alias("arxiv"),
        e["PubMed"].alias("pmid"), e["CorpusId"].cast("string").alias("corpus_id"), F.coalesce(F.get("publicationTypes", F.lit(0)), F.lit("unknown")).alias("kind"), F.col("citationCount").alias("citations"),
    )


def from_registry(works: DataFrame) -> DataFrame:
    """Registry payloads: titles and containers as arrays, years in nested date parts, split author names, references without DOI dropped."""
    name = lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"]))
    return works.select(
        "rec_id", F.coalesce(F.get("title", F.lit(0)), F.lit("")).alias("title"), _names(F.col("author"), name).alias("authors"), F.get(F.get("date_parts", F.lit(0)), F.lit(0)).alias("year"),
        F.get("container_title", F.lit(0)).alias("venue"), clean_doi(F.col("DOI")).alias("doi"), clean_abstract(F.col("abstract")).alias("abstract"), _names(F.col("reference"), lambda r: clean_doi(r["DOI"])).alias("referenced_works"),
    )


def from_flat(results: DataFrame) -> DataFrame:
    """Flat payloads: authors in one string, the year as text, open access only where ``inEPMC`` is Y."""
    authors = F.filter(F.transform(F.split(F.regexp_replace("authorString", r"\.$", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    return results.select(
        "rec_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce(authors, F.array().cast("array<string>")).alias("authors"), F.expr("try_cast(pubYear as int)").alias("year"), F.col("journalTitle").alias("venue"),
        clean_doi(F.col("doi")).alias("doi"), F.when(F.col("inEPMC") == "Y", F.concat(F.lit("pmc:"), "pmcid")).alias("oa_url"), clean_abstract(F.col("abstractText")).alias("abstract"),
    )


def is_preprint(venue: Column) -> Column:
    return F.coalesce(F.lower(venue).rlike("|".join(v.replace(".", r"\.") for v in vocab.PREPRINT_VENUES)), F.lit(False))


def anomalies(this_year: int) -> Column:
    """Flags of a record whose fields are missing or contradict each other."""
    year, cites = F.col("year"), F.coalesce("citations", F.lit(0))
    there = lambda c: F.coalesce(present(F.col(c)), F.lit(False))
    mismatch = (year >= this_year) & (cites > 300) | (year == this_year - 1) & (cites > 2000)
    flags = F.array(
        F.when(~there("title"), F.lit("no-title")),
        F.when(F.coalesce(F.size("authors"), F.lit(0)) <= 0, F.lit("no-authors")),
        F.when(~there("doi") & ~there("url") & ~there("oa_url"), F.lit("no-locator")),
        F.when(F.col("retracted"), F.lit("RETRACTED")),
        F.when(year > this_year + 1, F.concat(F.lit("implausible-year:"), year.cast("string"))),
        F.when(mismatch, F.concat(F.lit("citations-year-mismatch:"), cites.cast("string"), F.lit("@"), year.cast("string"))),
    )
    return F.array_compact(flags)


def match_keys(recs: DataFrame) -> DataFrame:
    """``(rec_id, key)``: seven kinds of keys of a record, for matching catalogues."""
    key = lambda kind, c: F.when(present(c), F.concat(F.lit(kind + ":"), c))
    keys = F.array(
        key("doi", clean_doi(F.col("doi"))), key("pmid", F.trim("pmid")), key("pmcid", F.trim("pmcid")), key("arxiv", clean_arxiv(F.col("arxiv"))),
        key("oa", F.trim("openalex")), key("s2", F.trim("corpus_id")), F.concat(F.lit("title:"), title_key(F.col("title"), F.col("year"))),
    )
    return recs.select("rec_id", F.explode(F.array_distinct(F.array_compact(keys))).alias("key"))


def merged(recs: DataFrame, group: str) -> DataFrame:
    """One record per group: first value that is there in ``rec_id`` order, longest author list, most citations, union of queries."""
    first = lambda c: F.min_by(F.col(c), F.when(present(F.col(c).cast("string")), F.col("rec_id"))).alias(c)
    g = recs.groupBy(group).agg(
        F.count(F.lit(1)).alias("rows"), first("title"), first("venue"), first("year"), first("doi"),
        F.max_by("authors", F.struct(F.coalesce(F.size("authors"), F.lit(0)), -F.col("rec_id"))).alias("authors"),
        F.nullif(F.max(F.greatest(F.coalesce("citations", F.lit(0)), F.lit(0))), F.lit(0)).alias("citations"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("found_by", F.array().cast("array<string>")))))).alias("found_by"),
    )
    return g


def by_citations(recs: DataFrame) -> DataFrame:
    """Records numbered by citations (missing as 0), ties by id, without a single-task sort."""
    return global_row_number(recs, [F.desc(F.coalesce("citations", F.lit(0))), F.asc("rec_id")], "place")


def citing_edges(works: DataFrame) -> DataFrame:
    """``(citing, cited)``, each pair once."""
    return works.select(_last_segment(F.col("id")).alias("citing"), F.explode("referenced_works").alias("r")).select("citing", _last_segment(F.col("r")).alias("cited")).filter("citing is not null and cited is not null").distinct()


def trend(rows: DataFrame, key: str, buckets: int = 60) -> DataFrame:
    """The ``buckets`` largest groups with their share of all rows; ties by key."""
    n = rows.agg(F.count(F.lit(1)).alias("total"))
    top = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(buckets)
    return top.crossJoin(F.broadcast(n))  # one row


def one_per_work(works: DataFrame) -> DataFrame:
    """The latest delivery of each work."""
    w = W.partitionBy("id").orderBy(F.desc_nulls_last("received_at"), F.desc("delivery_id"))
    return works.filter("id is not null").withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def works_predicate(first: int | None = None, last: int | None = None, kinds: Sequence[str] = (), open_access: bool = False, peer_reviewed: bool = False, words: str | None = None) -> Column:
    """One condition on records, from the options of a search; it is built from comparisons that reach the scan.

    Never retracted works; years from ``first`` to ``last`` (either may be open; a work without a year fails a bound); one of ``kinds``; with a copy that is free to read; no preprint by kind
    or venue; all ``words`` in the title or the abstract, whatever their case.  Without options only retracted works are left out.
    """
    p = ~F.coalesce(F.col("retracted"), F.lit(False))
    if first is not None:
        p = p & (F.col("year") >= first)
    if last is not None:
        p = p & (F.col("year") <= last)
    if kinds:
        p = p & F.col("kind").isin(*kinds)
    if open_access:
        p = p & F.coalesce(present(F.col("oa_url")), F.lit(False))
    if peer_reviewed:
        p = p & ~F.coalesce(is_preprint(F.col("venue")), F.lit(False)) & (F.coalesce("kind", F.lit("")) != "preprint")
    for w in (words or "").lower().split():
        p = p & (F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(w)) | F.contains(F.lower(F.coalesce("abstract", F.lit(""))), F.lit(w)))
    return F.coalesce(p, F.lit(False))


def year_clause(dialect: str, first: int | None, last: int | None) -> str:
    """A range of years as a catalogue spells it; '' without bounds.  Only one side is bounded in ``a-`` and ``-b``; the fourth needs both and takes 1800 and 2100."""
    if first is None and last is None:
        return ""
    if dialect == "openalex":
        if first is not None and last is not None:
            return f"publication_year:{first}-{last}"
        return f"publication_year:>{first - 1}" if first is not None else f"publication_year:<{last + 1}"
    if dialect == "s2":
        return f"{'' if first is None else first}-{'' if last is None else last}"
    if dialect == "crossref":  # one parameter, its parts joined with commas
        return ",".join([f"from-pub-date:{first}-01-01"] * (first is not None) + [f"until-pub-date:{last}-12-31"] * (last is not None))
    if dialect == "europepmc":
        return f"(PUB_YEAR:[{1800 if first is None else first} TO {2100 if last is None else last}])"
    raise ValueError(f"no such catalogue: {dialect}")
