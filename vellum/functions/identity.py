"""Identifiers and keys.  Three title keys exist on purpose: they serve different matches and differ in accents and scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import folded, present

RESOLVER = r"(?i)^https?://(dx\.)?(doi\.org|resolver\.example)/"
PREPRINTS = r"(?i)^https?://(arxiv\.org|preprints\.example)/abs/"


def _some(col: Column) -> Column:
    return F.when(present(col), col)


def clean_doi(doi: Column) -> Column:
    return _some(F.lower(F.trim(F.regexp_replace(F.regexp_replace(doi, RESOLVER, ""), "(?i)^doi:", ""))))


def clean_arxiv(arxiv: Column) -> Column:
    return _some(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(arxiv, PREPRINTS, ""), "(?i)^arxiv:", ""), r"(?i)v\d+$", "")))


def _year(year: Column) -> Column:
    return F.coalesce(year.cast("string"), F.lit("?"))


def title_key(title: Column, year: Column) -> Column:
    """For deduplication: accents folded; more than 15 characters, else null."""
    t = F.trim(F.regexp_replace(F.regexp_replace(folded(title), "[^a-z0-9 ]", " "), r"\s+", " "))
    return F.when(F.length(t) > 15, F.concat(t, F.lit("|"), _year(year)))


def ledger_title_key(title: Column, year: Column) -> Column:
    """For ingest: accented letters become spaces."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9 ]", " "), r"\s+", " "))
    return F.when(F.length(t) > 15, F.concat(t, F.lit("|"), _year(year)))


def cache_title(title: Column) -> Column:
    """For the cache: letters of all scripts are kept."""
    return F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", " "))


def url_key(url: Column) -> Column:
    return F.lower(F.regexp_replace(url, r"(?s)[#?].*$", ""))


def normal_url(url: Column) -> Column:
    """Without fragment, tracking parameters and trailing slashes, in lower case; what is no URL is trimmed and lowered."""
    head = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)"
    u = F.trim(url)
    origin, path = F.regexp_extract(u, head, 1), F.regexp_extract(u, head + "([^?#]*)", 2)
    params = F.filter(F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~p.rlike("(?i)^(utm_|ref|source|fbclid|gclid)"))
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    return F.lower(F.when(origin == "", u).otherwise(F.concat(origin, F.regexp_replace(path, "/+$", ""), query)))


def cache_key(doi: Column, pmcid: Column, pmid: Column, arxiv: Column, openalex: Column, url: Column, title: Column, year: Column) -> Column:
    """``kind-`` and the first 12 digits of a hash, by the first identifier that is there; null without any."""

    def key(kind: str, there: Column, value: Column) -> Column:
        return F.when(present(there), F.concat(F.lit(kind + "-"), F.substring(F.sha1(value), 1, 12)))

    by_title = cache_title(title)
    return F.coalesce(
        key("doi", doi, F.lower(F.trim(F.regexp_replace(F.regexp_replace(doi, RESOLVER, ""), "(?i)^doi:", "")))),
        key("pmcid", pmcid, F.upper(F.trim(pmcid))),
        key("pmid", pmid, F.trim(pmid)),
        key("arxiv", arxiv, F.lower(F.trim(F.regexp_replace(arxiv, r"(?i)v\d+$", "")))),
        key("oa", openalex, F.upper(F.trim(openalex))),
        key("url", url, normal_url(url)),
        F.when(F.length(by_title) >= 12, F.concat(F.lit("title-"), F.substring(F.sha1(F.concat(by_title, F.lit("|"), F.coalesce(year.cast("string"), F.lit("")))), 1, 12))),
    )


def author_key(name: Column) -> Column:
    """``surname,initial``; for ``Last, F.`` and ``First Last``; null for names that are too short."""
    n = F.regexp_replace(F.trim(name), r"\s+", " ")
    comma = F.contains(n, F.lit(","))
    surname = F.when(comma, F.split_part(n, F.lit(","), F.lit(1))).otherwise(F.regexp_extract(n, r"([^ ]*)$", 1))
    rest = F.when(comma, F.split_part(n, F.lit(","), F.lit(2))).otherwise(F.regexp_replace(n, r" ?[^ ]*$", ""))
    surname = F.regexp_replace(F.lower(surname), r"[^\p{L}-]", "")
    return F.when((F.length(n) >= 3) & (F.length(surname) >= 2), F.concat(surname, F.lit(","), F.lower(F.regexp_extract(rest, r"(\p{L})", 1))))


def route(identifier: Column) -> Column:
    """Where an identifier is looked up: openalex, doi, pmid, arxiv or unrecognised."""
    i = F.trim(identifier)
    return F.when(i.rlike(r"(?i)^W\d+$"), "openalex").when(clean_doi(i).rlike(r"^10\.\d{4,}/"), "doi").when(i.rlike(r"^\d{7,8}$"), "pmid").when(clean_arxiv(i).rlike(r"^\d{4}\.\d{4,5}"), "arxiv").otherwise("unrecognised")


def language_tag(tag: Column) -> Column:
    return tag.rlike("^(auto|[a-z]{2,3}(-[A-Za-z0-9]{2,8})*)$")
