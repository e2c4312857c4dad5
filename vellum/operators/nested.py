"""Deeply nested records as flat child tables (problem 4).

One pass over the payload: nested ``transform`` calls attach the ancestor's key and the place of every element,
``flatten`` and ``concat`` combine the arrays of one target, and a single ``inline`` emits its rows.  No shuffle and no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAF = "array<struct<delivery_id:bigint,child:string,pos:bigint,val:string>>"


def _leaf(key: Column, child: str, pos: Column, val: Column) -> Column:
    return F.struct(key.alias("delivery_id"), F.lit(child).alias("child"), pos.cast("bigint").alias("pos"), val.alias("val"))


def _or_empty(col: Column) -> Column:
    return F.coalesce(col, F.array().cast(LEAF))


def author_leaves(key: Column, authorships: Column) -> Column:
    """``author`` leaves: the 0-based place counts null entries; null names are left out by the caller."""
    return _or_empty(F.transform(authorships, lambda a, i: _leaf(key, "author", i, a["author"]["display_name"])))


def reference_leaves(key: Column, refs: Column) -> Column:
    """``reference`` leaves with their 0-based place."""
    return _or_empty(F.transform(refs, lambda r, i: _leaf(key, "reference", i, r)))


def word_leaves(key: Column, index: Column) -> Column:
    """``word`` leaves of an inverted index: one for each non-null position of each word."""
    return _or_empty(F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(F.coalesce(e["value"], F.array().cast("array<int>")), lambda p: _leaf(key, "word", p, e["key"])))))


def location_leaves(key: Column, location: Column) -> Column:
    """``landing_page`` and ``venue`` leaves at place 0."""
    zero = F.lit(0)
    return F.array(_leaf(key, "landing_page", zero, location["landing_page_url"]), _leaf(key, "venue", zero, location["source"]["display_name"]))


def flat_leaves(works: DataFrame) -> DataFrame:
    """One row ``(delivery_id, child, pos, val)`` for each non-null leaf of each delivery.

    Null structs, arrays, maps, entries and values give no row; empty strings are values and stay; an empty table gives no
    rows; a repeated delivery gives its rows again; a position that is null gives no row; further columns are ignored.
    """
    key = F.col("delivery_id")
    leaves = F.concat(
        author_leaves(key, F.col("authorships")),
        reference_leaves(key, F.col("referenced_works")),
        word_leaves(key, F.col("abstract_inverted_index")),
        location_leaves(key, F.col("primary_location")),
    )
    kept = F.filter(leaves, lambda x: x["val"].isNotNull() & x["pos"].isNotNull())
    # inline_outer: for a plain inline the optimizer would infer a filter on the array's size and build the array twice
    return works.select(kept.alias("leaves")).selectExpr("inline_outer(leaves)").filter(F.col("child").isNotNull())


def child_tables(works: DataFrame) -> dict[str, DataFrame]:
    """The related flat tables, each with its parent's key: work, authorship, reference, word, location."""
    key = F.col("delivery_id")
    work = works.select("delivery_id", "id", "doi", "display_name", "publication_year", "work_type", "cited_by_count", "lang", "is_retracted", F.col("ids.pmid").alias("pmid"), F.col("ids.pmcid").alias("pmcid"), F.col("ids.openalex").alias("openalex"), F.col("best_oa_location.pdf_url").alias("pdf_url"), F.col("open_access.oa_url").alias("oa_url"), F.col("primary_topic.display_name").alias("topic"), "received_at")
    authorship = works.select(F.transform("authorships", lambda a, i: F.struct(key.alias("delivery_id"), i.cast("bigint").alias("pos"), a["author"]["display_name"].alias("author"), a["position_tag"].alias("position_tag"), a.isNull().alias("is_null_entry"))).alias("x")).selectExpr("inline(x)")
    reference = works.select(F.transform("referenced_works", lambda r, i: F.struct(key.alias("delivery_id"), i.cast("bigint").alias("pos"), r.alias("cited"))).alias("x")).selectExpr("inline(x)")
    word = works.select(word_leaves(key, F.col("abstract_inverted_index")).alias("x")).selectExpr("inline(x)").select("delivery_id", "pos", F.col("val").alias("word"))
    location = works.filter(F.col("primary_location").isNotNull()).select("delivery_id", F.col("primary_location.landing_page_url").alias("landing_page_url"), F.col("primary_location.source.display_name").alias("venue"), F.col("primary_location.source.kind_tag").alias("kind_tag"))
    return {"work": work, "authorship": authorship, "reference": reference, "word": word, "location": location}
