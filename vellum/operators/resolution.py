"""Entity resolution over catalogues, upserts into the ledger and cache lookups: equi-joins on keys, never pairs of records.

A record has several keys; records that share any are one entity, directly or through others (connected components over stars, so that a key of n records
gives n - 1 edges).  Identifiers without a digit other than 0 (of a DOI: after its first slash) stand in for a missing one and match nothing.
Null and empty fields give no key; a record without keys is an entity of its own; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import clean_arxiv, clean_doi, ledger_title_key, url_key
from ..functions.text import present
from ..sources.shared import Scratch
from . import catalogue
from .connected import connect
from .ranking import global_row_number
from .skew import HOT_ROWS, salted_lookup

USABLE = r"^(title|url):|^doi:[^/]*/.*[1-9]|^(pmid|pmcid|arxiv|oa|s2):.*[1-9]"


def groups_of(keys: DataFrame, ids: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(rec_id, group_id)`` of all ``ids (rec_id)``: the smallest record linked by ``keys (rec_id, key)`` directly or through others."""
    scratch = Scratch(keys.sparkSession, "resolution")
    keys = scratch.keep(keys.select("rec_id", F.xxhash64("key").alias("k1"), F.hash("key").alias("k2")).distinct())
    centre = keys.groupBy("k1", "k2").agg(F.min("rec_id").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    edges = salted_lookup(keys, scratch.keep(centre), ["k1", "k2"], "rec_id", "inner", hot_rows, counted="n").select("a", F.col("rec_id").alias("b"))
    labels = connect(edges, hot_rows, scratch).withColumnRenamed("id", "rec_id")
    return ids.join(labels, "rec_id", "left").select("rec_id", F.coalesce("group_id", "rec_id").alias("group_id"))


def resolve(recs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(rec_id, group_id)`` by seven keys: DOI, PMID, PMCID, arXiv, OpenAlex and corpus ids, and title with year."""
    keys = catalogue.match_keys(recs.filter("rec_id is not null")).filter(F.col("key").rlike(USABLE))
    return groups_of(keys, recs.filter("rec_id is not null").select("rec_id"), hot_rows)


def _entry_keys(rows: DataFrame, owner: str) -> DataFrame:
    """``(owner, rank, key)``: the ledger's keys of a record in the order in which they are tried."""
    key = lambda kind, c: F.when(present(c), F.concat(F.lit(kind + ":"), c))
    keys = F.array(
        key("doi", clean_doi(F.col("doi"))), key("pmid", F.trim("pmid")), key("arxiv", clean_arxiv(F.col("arxiv"))), key("oa", F.trim("openalex")),
        key("url", url_key(F.col("url"))), key("title", ledger_title_key(F.col("title"), F.col("year"))),
    )
    return rows.select(owner, F.posexplode(keys).alias("rank", "key")).filter(F.col("key").rlike(USABLE))


def _first(column: str) -> Column:
    """The value of the smallest record that has one."""
    return F.min_by(F.col(column), F.when(present(F.col(column).cast("string")), F.col("rec_id"))).alias(column)


def upsert(sources: DataFrame, recs: DataFrame, width: int = 9) -> DataFrame:
    """``(id, action, records, year, venue, doi, n_queries)``: the ledger after the records it doesn't stand for yet came in.

    A record is matched to the source that its first known key names (of several sources with a key, the one of the largest id).  Matched records fill
    what the source lacks, the smallest record first, and add their queries (``merged``); sources without matches are ``kept``.  The other records
    are grouped among themselves by the same keys and give one new source each, numbered after the largest id (``added``).
    """
    scratch = Scratch(recs.sparkSession, "upsert")
    facts = ("doi", "pmid", "arxiv", "openalex", "url", "venue", "found_by")
    held = sources.join(recs.select("rec_id", *facts), "rec_id", "left").select("id", "title", "year", *facts)
    held = scratch.keep(held.filter("id is not null"))
    new = scratch.keep(recs.filter("rec_id is not null").join(sources.filter("rec_id is not null").select("rec_id"), "rec_id", "left_anti").select("rec_id", "title", "year", *facts))
    index = _entry_keys(held, "id").groupBy("key").agg(F.max("id").alias("id"))
    keys = scratch.keep(_entry_keys(new, "rec_id"))
    hits = scratch.keep(salted_lookup(keys, index, ["key"], "rec_id").groupBy("rec_id").agg(F.min_by("id", "rank").alias("id")))
    by = F.coalesce("found_by", F.array().cast("array<string>"))
    matched = new.join(hits, "rec_id").groupBy("id").agg(F.count(F.lit(1)).alias("records"), *[_first(c).alias(f"_{c}") for c in ("year", "venue", "doi")], F.flatten(F.collect_set(by)).alias("_by"))
    queries = lambda a: F.size(F.array_distinct(F.filter(a, lambda x: x.isNotNull() & (x != "")))).cast("bigint").alias("n_queries")
    old = held.join(matched, "id", "left").select(
        "id", F.when(F.col("records").isNull(), "kept").otherwise("merged").alias("action"), F.coalesce("records", F.lit(0)).alias("records"),
        *[F.coalesce(F.when(present(F.col(c).cast("string")), F.col(c)), f"_{c}").alias(c) for c in ("year", "venue", "doi")], queries(F.concat(by, F.coalesce("_by", F.array().cast("array<string>")))),
    )
    rest = new.join(hits.select("rec_id"), "rec_id", "left_anti")
    own = groups_of(keys.join(hits.select("rec_id"), "rec_id", "left_anti").select("rec_id", "key"), rest.select("rec_id"))
    added = rest.join(own, "rec_id").groupBy("group_id").agg(F.count(F.lit(1)).alias("records"), *[_first(c) for c in ("year", "venue", "doi")], F.flatten(F.collect_set(by)).alias("_by"))
    last = sources.agg(F.coalesce(F.max(F.substring("id", 2, 12).cast("bigint")), F.lit(0)).alias("last"))
    numbered = global_row_number(added, [F.asc("group_id")], "rn").crossJoin(F.broadcast(last))  # one row
    n = (F.col("last") + F.col("rn")).cast("string")
    fresh = numbered.select(F.concat(F.lit("S"), F.lpad(n, width, "0")).alias("id"), F.lit("added").alias("action"), "records", "year", "venue", "doi", queries(F.col("_by")))
    return old.unionByName(fresh)


def cache_lookup(lookups: DataFrame, entries: DataFrame, least: int) -> DataFrame:
    """``(rec_id, key, hit, chars)``: whether the cache holds at least ``least`` characters under a record's key; ``entries (key, chars)``."""
    held = entries.filter("key is not null").groupBy("key").agg(F.max("chars").alias("chars"))
    rows = salted_lookup(lookups, held, ["key"], "rec_id", "left")
    return rows.select("rec_id", "key", F.coalesce(F.col("chars") >= least, F.lit(False)).alias("hit"), "chars")
