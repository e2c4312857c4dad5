"""Records that differ only in formatting (problem 1): progressive partition refinement.

Level 1 groups by invariants that cost little and are narrow to shuffle: year, stripped length and letter histogram of the
title.  Only rows in level-1 classes with several members go on to level 2, which compares a 128-bit digest of the whole
stripped title.  Both levels combine on the map side; rows find their class through a lookup that salts hot classes.

Defined results: a null or empty title (also one that is all space and punctuation) and a line that can't be read as a
record are never copies; two missing years agree; a year that is no number counts as missing; rows with the same
key and the same id count once each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import HOT_ROWS, salted_lookup
from ..sources.shared import Scratch

#: Unicode white space, the four separators that Python and the JVM also take as space, and category P.
SPACE_OR_PUNCT = "[\\p{IsWhite_Space}\\x1c-\\x1f\\p{P}]+"


def stripped(title: Column) -> Column:
    """The title without white space, punctuation and letter case; upper before lower, so that ß and SS agree.

    The replacement stands between the two, since the optimizer would reduce lower(upper(x)) to lower(x).
    """
    return F.lower(F.regexp_replace(F.upper(title), SPACE_OR_PUNCT, ""))


def letter_histogram(text: Column) -> Column:
    """64 bits that depend on which characters occur how often, not on their order."""
    return F.xxhash64(F.sort_array(F.split(text, "")))


def _named(entries: Column, name: str) -> Column:
    return F.get(F.filter(entries, lambda e: F.lower(F.trim(e["key"])) == name), 0)["value"]


def read_lines(lines: DataFrame) -> DataFrame:
    """``(line_id, title, year)`` of raw lines: a JSON object, or tab-separated ``key=value`` pairs; keys in any case and order.

    Blank lines, comments (``#``, ``//``) and lines that broke off give no row: JSON must parse whole, and every
    tab-separated piece must hold ``=``.
    """
    raw = F.regexp_replace("raw", "^[\\s\\p{IsWhite_Space}]+|[\\s\\p{IsWhite_Space}]+$", "")
    rows = lines.select("line_id", raw.alias("s")).filter((F.col("s") != "") & ~F.col("s").rlike("^(#|//)"))
    as_json = F.map_entries(F.expr("try_cast(try_parse_json(s) as map<string,string>)"))
    pieces = F.split("s", "\t")
    as_pairs = F.transform(pieces, lambda p: F.struct(F.regexp_extract(p, "^([^=]*)=", 1).alias("key"), F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1).alias("value")))
    entries = F.when(F.col("s").startswith("{"), as_json).when(F.forall(pieces, lambda p: p.contains("=")), as_pairs)
    rows = rows.select("line_id", entries.alias("e")).filter(F.col("e").isNotNull())
    year = F.regexp_extract(F.trim(_named(F.col("e"), "year")), "^([+-]?\\d{1,9})(\\.0+)?$", 1)
    return rows.select("line_id", _named(F.col("e"), "title").alias("title"), F.nullif(year, F.lit("")).cast("int").alias("year"))


def _refined(records: DataFrame, scratch: Scratch, hot_rows: int, alone: bool) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """Both levels: ``(tab, id)`` of rows alone in their level-1 class (only if asked for), members of the other classes, and the level-2 classes.

    Members are ``(tab, yr, id, digest)``, classes ``(tab, yr, digest, keep_id, copies)``.
    """
    rows = records.select("tab", "id", F.coalesce(F.col("year").cast("string"), F.lit("")).alias("yr"), stripped(F.col("title")).alias("key")).filter(F.col("key") != "")
    rows = rows.select("tab", "id", "yr", F.length("key").alias("len"), letter_histogram(F.col("key")).alias("hist"), "key")
    level1 = ["tab", "yr", "len", "hist"]
    classes = rows.groupBy(*level1).agg(F.count(F.lit(1)).alias("n"), *([F.min("id").alias("id")] if alone else []))
    classes = scratch.keep(classes if alone else classes.filter("n > 1"))
    lone = classes.filter("n = 1").select("tab", "id") if alone else None
    members = salted_lookup(rows, classes.filter("n > 1").select(*level1, "n"), level1, "id", "left_semi", hot_rows, counted="n")
    members = scratch.keep(members.select("tab", "yr", "id", F.unhex(F.md5("key")).alias("digest")))
    return lone, members, members.groupBy("tab", "yr", "digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))


def copies(records: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(tab, id, keep_id, copies)`` for each row of ``records (tab, id, title, year)`` that has at least one copy.

    ``keep_id`` is the smallest id of the copies.
    """
    scratch = Scratch(records.sparkSession, "copies")
    _, members, groups = _refined(records, scratch, hot_rows, False)
    groups = scratch.keep(groups.filter("copies > 1"))
    return salted_lookup(members, groups, ["tab", "yr", "digest"], "id", "inner", hot_rows, counted="copies").select("tab", "id", "keep_id", "copies")


def both_tables(recs: DataFrame, lines: DataFrame) -> DataFrame:
    """Records of both inputs in one form: ``(tab, id, title, year)``."""
    a = recs.select(F.lit("recs").alias("tab"), F.col("rec_id").alias("id"), "title", "year")
    b = read_lines(lines).select(F.lit("rec_lines").alias("tab"), F.col("line_id").alias("id"), "title", "year")
    return a.unionByName(b)


def found(recs: DataFrame, lines: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(tab, keep_id, dup_id)``: one row for each copy beyond the one kept."""
    return copies(both_tables(recs, lines), hot_rows).filter("id <> keep_id").select("tab", "keep_id", F.col("id").alias("dup_id"))


def one_each(recs: DataFrame, lines: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(tab, keep_id, copies)``: one row for each distinct title and year, with the number of its copies (1 when alone).

    These are the rows alone on level 1 and the classes of level 2.
    """
    lone, _, groups = _refined(both_tables(recs, lines), Scratch(recs.sparkSession, "records"), hot_rows, True)
    return lone.select("tab", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("copies")).unionByName(groups.select("tab", "keep_id", "copies"))
