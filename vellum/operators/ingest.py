"""Batches of records: parsing, coercion, validation and outcomes, one pass over the lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import numbers_in, numbers_missing, present


def parse_lines(lines: DataFrame) -> DataFrame:
    """``(line_id, status, fields)``: JSON objects as string maps; blank lines and comments dropped, broken ones ``failed``."""
    s = F.regexp_replace("raw", r"^\s+|\s+$", "")
    kept = lines.select("line_id", s.alias("s")).filter((F.col("s") != "") & ~F.col("s").rlike("^(#|//)"))
    fields = F.expr("try_cast(try_parse_json(s) as map<string,string>)")
    ok = F.col("s").startswith("{") & F.expr("try_parse_json(s)").isNotNull()
    return kept.select("line_id", F.when(ok, "parsed").otherwise("failed").alias("status"), F.when(ok, fields).alias("fields"))


def batch_records(files: DataFrame) -> DataFrame:
    """``(file, line, status, flags)`` of whole batch files ``(file, text)``: a JSON array, or a JSON object per line.

    ``line`` counts the elements of an array or the lines of the file from 1; blank lines and comments (``#``, ``//``) are skipped.  ``status`` is ``parsed``; ``failed``
    for a line that isn't one JSON object, or an array that doesn't parse (at line 1); or ``empty``, at line 0, for a file without records (also a null one).
    ``flags`` are the fields in flag form: dashes for underscores, null fields left out, arrays joined with commas, objects as ``key:value`` joined with commas.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    files = files.select("file", F.coalesce("text", F.lit("")).alias("raw"), text.alias("t"))
    is_array = F.col("t").startswith("[")
    array = F.expr("try_cast(try_parse_json(t) as array<variant>)")
    lines = F.transform(F.split("raw", "\r?\n"), lambda x, i: F.struct((i + 1).alias("line"), F.regexp_replace(x, r"^\s+|\s+$", "").alias("s")))
    lines = F.filter(lines, lambda x: (x["s"] != "") & ~x["s"].startswith("#") & ~x["s"].startswith("//"))
    elements = F.transform(array, lambda x, i: F.struct((i + 1).alias("line"), F.to_json(x).alias("s")))
    broken = F.array(F.struct(F.lit(1).alias("line"), F.lit("").alias("s")))
    rows = files.select("file", F.when(is_array, F.coalesce(elements, broken)).otherwise(lines).alias("rows"))
    empty = rows.filter(F.size("rows") == 0).select("file", F.lit(0).alias("line"), F.lit("empty").alias("status"), F.lit(None).cast("map<string,string>").alias("flags"))
    each = rows.select("file", F.explode("rows").alias("x")).select("file", "x.line", "x.s").withColumn("fields", F.expr("try_cast(try_parse_json(s) as map<string,variant>)"))
    ok = F.col("s").startswith("{") & F.col("fields").isNotNull()
    return each.select("file", "line", F.when(ok, "parsed").otherwise("failed").alias("status"), F.when(ok, flags(F.col("fields"))).alias("flags")).unionByName(empty)


def flags(fields: Column) -> Column:
    """A record's fields ``map<string, variant>`` as strings; of keys that only differ in dashes and underscores the last one counts."""
    kind = lambda v: F.schema_of_variant(v)
    text = lambda v: F.try_variant_get(v, "$", "string")
    items = lambda v: F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(text(x), F.lit("null"))), ",")
    pairs = lambda v: F.array_join(F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: F.concat(e["key"], F.lit(":"), F.coalesce(text(e["value"]), F.lit("null")))), ",")
    value = lambda v: F.when(kind(v).startswith("ARRAY"), items(v)).when(kind(v).startswith("OBJECT"), pairs(v)).otherwise(text(v))
    entries = F.transform(F.map_entries(fields), lambda e: F.struct(F.replace(e["key"], F.lit("_"), F.lit("-")).alias("key"), value(e["value"]).alias("value")))
    entries = F.filter(entries, lambda e: e["value"].isNotNull())
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def field_names(fields: Column) -> Column:
    """The keys of a record in one spelling: lower case, dashes for underscores, in order, once each."""
    return F.array_sort(F.array_distinct(F.transform(F.map_keys(fields), lambda k: F.replace(F.lower(k), F.lit("_"), F.lit("-")))))


def unknown_fields(fields: Column, allowed: Sequence[str]) -> Column:
    return F.array_except(field_names(fields), F.array(*map(F.lit, allowed)))


def outcome(refused: Column, failed: Column) -> Column:
    return F.when(failed, "failed").when(refused, "refused").otherwise("applied")


def screen_problems(known: Column) -> Column:
    """Codes of what is wrong with a screening decision; empty when it is fine."""
    verdict, reason = F.col("verdict"), F.col("reason")
    legal = F.coalesce(verdict.isin(*vocab.VERDICTS), F.lit(False))
    codes = F.array(
        F.when(~F.coalesce(known, F.lit(False)), F.lit("unknown-source")), F.when(~legal, F.lit("bad-verdict")),
        F.when((verdict == "exclude") & ~F.coalesce(present(reason), F.lit(False)), F.lit("no-reason")),
        F.when(present(reason) & ~reason.isin(*vocab.EXCLUSION_REASONS), F.lit("bad-reason")),
    )
    return F.array_join(F.array_compact(codes), ",")


def evidence_status(known: Column) -> Column:
    """The first rule that stops a record, in order: source, range, keep threshold, figures; else ``applied``."""
    score, quote = F.col("score"), F.col("quote")
    missing = present(quote) & (F.size(numbers_missing(F.col("summary"), quote)) > 0)
    return (
        F.when(~F.coalesce(known, F.lit(False)), "failed:unknown-source").when(F.col("score").isNull() | (score < 1) | (score > 10), "failed:score-range")
        .when(score < vocab.KEEP_SCORE, "failed:below-keep").when(F.coalesce(missing, F.lit(False)), "refused:number-not-in-quote").otherwise("applied")
    )


def figures(text: Column) -> Column:
    return F.array_join(numbers_in(text), " ")
