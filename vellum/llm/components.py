"""Consolidating pairwise matches into groups (problem 3): deterministic Borůvka hooking.

Rows that share an identifier are linked to the smallest row of that identifier, so an identifier of n rows gives n - 1 edges
and never all pairs.  Then, until no edge remains: every component selects its smallest outgoing edge (by lower, then
higher end), the trees so formed collapse by pointer doubling, and the edges are relabelled with the roots and
deduplicated.  Since the smallest edge of a tree holds the tree's smallest vertex, every root is the smallest of its
tree and the final label is the group's smallest id.  Each round at least halves the components that still have edges.

Hubs are spread by salted lookups; every table of a round is written to the shared folder, and no link, label or
component is sent to the driver (only counts are).

Defined results: null ids are left out; a row without a match is in no group; repeated edges and self-edges change
nothing; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.connected import connect
from ..operators.skew import HOT_ROWS, salted_lookup
from ..sources.shared import Scratch

#: What stands in for a missing identifier.
STAND_INS = ("", "-", "--", "n/a", "na", "n.a.", "nan", "none", "null", "nil", "unknown", "missing", "pending", "tba", "tbd", "?", "undefined")


def _bare(col: Column) -> Column:
    return F.lower(F.regexp_replace(col, "[\\s\\p{IsWhite_Space}\\p{Cf}]+", ""))


def _known(col: Column) -> Column:
    """Null for stand-ins and for identifiers that are nothing but zeros."""
    return F.when(~col.isin(*STAND_INS) & ~col.rlike("^[w0./-]*$") & (col != ""), col)


def doi_key(col: Column) -> Column:
    """The DOI from its ``10.`` on; null without a registrant and a digit in the suffix."""
    doi = F.regexp_extract(_bare(col), "(10\\.\\d{4,9}/.+)$", 1)
    return F.when(doi.rlike("^10\\.\\d+/.*\\d"), doi)


def arxiv_key(col: Column) -> Column:
    """The arXiv id without prefix, URL and version."""
    plain = F.regexp_replace(_bare(col), "^(https?:)?//[^/]+/(abs|pdf)/|^arxiv[:.]?|\\.pdf$", "")
    return _known(F.regexp_extract(plain, "^(\\d{4}\\.\\d{4,5}|[a-z-]+(?:\\.[a-z]{2})?/\\d{7})(?:v\\d+)?$", 1))


def pmid_key(col: Column) -> Column:
    """The digits, without leading zeros and a decimal part of zero."""
    return _known(F.regexp_extract(_bare(col), "^(?:pmid[:.]?|https?://[^/]+/(?:[^/]+/)*)?0*(\\d+)(?:\\.0+)?/?$", 1))


def openalex_key(col: Column) -> Column:
    """``w`` and digits, from any URL form."""
    return _known(F.regexp_extract(_bare(col), "(?:^|[/:])(w\\d+)/?$", 1))


def identifier_keys(recs: DataFrame) -> DataFrame:
    """``(key, rec_id)``: one row per identifier that a row names; an arXiv DOI counts as the arXiv id."""
    doi = doi_key(F.col("doi"))
    own = F.regexp_extract(doi, "^10\\.48550/arxiv\\.(.+)$", 1)
    keys = F.array(
        F.concat(F.lit("d:"), F.when(own == "", doi)),
        F.concat(F.lit("a:"), arxiv_key(F.nullif(own, F.lit("")))),
        F.concat(F.lit("a:"), arxiv_key(F.col("arxiv"))),
        F.concat(F.lit("p:"), pmid_key(F.col("pmid"))),
        F.concat(F.lit("o:"), openalex_key(F.col("openalex"))),
    )
    return recs.filter(F.col("rec_id").isNotNull()).select("rec_id", F.explode(F.array_distinct(F.array_compact(keys))).alias("key"))


def star_edges(keys: DataFrame, scratch: Scratch, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(a, b)``, a < b: each row of a key and the key's smallest row."""
    keys = scratch.keep(keys.select(F.xxhash64("key").alias("k1"), F.hash("key").alias("k2"), "rec_id"))
    centre = scratch.keep(keys.groupBy("k1", "k2").agg(F.min("rec_id").alias("a"), F.max("rec_id").alias("z"), F.count(F.lit(1)).alias("n")).filter("a <> z").drop("z"))
    edges = salted_lookup(keys, centre, ["k1", "k2"], "rec_id", "inner", hot_rows, counted="n")
    return edges.select("a", F.col("rec_id").alias("b")).filter("a <> b").distinct()


def groups(recs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(rec_id, group_id)`` for every row in a group of two or more."""
    scratch = Scratch(recs.sparkSession, "groups")
    edges = star_edges(identifier_keys(recs), scratch, hot_rows)
    return connect(edges, hot_rows, scratch).withColumnRenamed("id", "rec_id")
