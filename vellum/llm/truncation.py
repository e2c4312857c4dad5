"""Texts cut off by field limits (problem 6).

Lengths are recomputed under alternative encodings: characters, UTF-8 bytes, UTF-16 units, and characters after markup
escaping, JSON escaping and newline conversion.  A histogram per source and encoding shows hidden storage limits as
lengths that far more texts have than the lengths around, by a likelihood ratio, most of the excess stopping in mid-sentence.

Then endings are inspected.  Marks of omission, halves of a tag, entity or character, and a last sentence without an end show a
cut text at any length, since texts are also cut in mid-transfer.  Two kinds of endings show nothing by themselves: those of whole sentences, and
open ones of a list of keywords, a cell, an address or a registration.  Texts with these are cut where their length is a limit of their source
and texts of that ending are so many more there than at the lengths around that at least SURE of them are there because of the limit.

Defined results: null, empty and blank texts and placeholders (at most three words) are no cases; a key that occurs
several times is one case if any of its texts is cut; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import Scratch

ENCODINGS = ("characters", "utf8", "utf16", "markup", "json", "crlf")
#: A length is a limit if the logarithm of how much likelier its number of texts is under a rate of its own than under that of the AROUND lengths on either
#: side is at least LIKELY, and MOSTLY of the texts in excess stop in mid-sentence.
LIKELY, AROUND, MOSTLY = 14.0, 15, 0.5
#: Texts that end whole or open at a limit are cut if this share of them is in excess of the lengths around.
SURE = 0.9

#: Unicode white space.
_SPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))
_CLOSE = "[\\s\\p{IsWhite_Space}\"”“»›’'`*_]*"


def _count(text: Column, chars: str) -> Column:
    """How many of ``chars`` the text holds; most texts hold none, which a byte search finds out."""
    some = F.lit(False)
    for c in chars:
        some = some | F.contains(text, F.lit(c))
    return F.when(some, F.length(text) - F.length(F.translate(text, chars, ""))).otherwise(0)


def lengths(text: Column) -> dict[str, Column]:
    """The length under each encoding."""
    chars, size = F.length(text), F.octet_length(text)
    astral = F.when(size == chars, 0).otherwise(chars - F.length(F.regexp_replace(text, "[\\x{10000}-\\x{10FFFF}]", "")))
    breaks = _count(text, "\n")
    return {
        "characters": chars,
        "utf8": size,
        "utf16": chars + astral,
        "markup": chars + 4 * _count(text, "&") + 3 * _count(text, "<>") + 5 * _count(text, "\"") + 4 * _count(text, "'"),
        "json": chars + _count(text, "\"\\\r\t") + breaks,
        "crlf": chars + breaks,
    }


def ending(text: Column) -> Column:
    """``cut``, ``open`` (stops without an end, in a form that need not have one) or ``whole``; null for placeholders.

    Only one expression runs over the whole text, the one that finds its last sentence.
    """
    s = F.btrim(text, F.lit(_SPACE))
    end = F.right(s, F.lit(120))
    mark = end.rlike("(\\.\\.\\.|…|[\\[(](?:\\.\\.\\.|…)[\\])]|&hellip;|&#8230;|&#x2026;)" + _CLOSE + "$")
    half = end.rlike("(<(/?[A-Za-z][^<>]*|/)?|&#?\\w{0,8}|\\x{FFFD}+)$")
    body = F.when(F.endswith(s, F.lit(">")), F.regexp_replace(s, "(?:</?[A-Za-z][^<>]*>\\s*)+$", "")).otherwise(s)
    body = F.when(F.right(body, F.lit(1)).isin("]", ")"), F.regexp_replace(body, "[\\[(](?:pp?|S|§)\\.?\\s?\\d[\\d–-]*[\\])]$", "")).otherwise(body)
    last = F.regexp_replace(F.btrim(body, F.lit(_SPACE)), "(?s)^.*[.!?][\"”»’')\\]]*\\s+", "")
    last = F.regexp_replace(last, "^(<[^<>]*>|[\\s\"“„«*_'])+", "")
    last = F.btrim(last, F.lit(_SPACE + "\"”“»›’'`*_"))
    number = last.rlike("(^|[\\s(=<>≤≥±-])0[.,]$")
    ended = last.rlike("[.!?。][\"”»’')\\]]*$")
    digits = F.regexp_count(last, F.lit("(?<![\\p{L}\\d])\\d[\\d.,]*"))
    words = F.regexp_count(last, F.lit("[\\p{L}\\d][\\p{L}\\d.,'’-]*"))
    labelled = last.rlike("^[\\p{L}][\\p{L} '-]{1,30}( \\d+)?\\s?:\\s")
    code = last.rlike("(^|\\s)\\S*\\p{L}\\S*[-/]\\d+$|\\S\\.\\p{L}+/\\S+$|https?://\\S+$|^\\|.*\\|$")
    bracketed = last.rlike("^[(\\[].*[)\\]]$")
    cell = digits * 2 >= words
    short = (F.length(s) < 120) & (F.regexp_count(s, F.lit("\\S+")) <= 3)
    return F.when(text.isNull() | (s == "") | (short & ~mark & ~half), F.lit(None).cast("string")).when(mark | half | number, "cut").when(ended | (last == ""), "whole").when(labelled | code | bracketed | cell, "open").otherwise("cut")


def measured(texts: DataFrame) -> DataFrame:
    """``(tab, row_key, source, ending, sizes, digest)`` of ``texts (tab, row_key, source, text)``: one pass over the texts."""
    sizes = F.array(*[v.cast("int") for v in lengths(F.col("text")).values()])
    rows = texts.filter("text is not null and text <> '' and row_key is not null")
    return rows.select("tab", "row_key", F.coalesce("source", F.lit("")).alias("source"), ending(F.col("text")).alias("ending"), sizes.alias("sizes"), F.xxhash64("text").alias("digest"))


def _by_encoding(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*columns, F.posexplode("sizes").alias("encoding", "size"))


def limits(rows: DataFrame) -> DataFrame:
    """``(tab, source, encoding, size, texts, stopped, excess, open_cut, whole_cut, own)``: hidden limits of each source, and of each table at source ``*``.

    A table's limit also stands, as not ``own``, at every source of which a text stops in mid-sentence there.

    Equal texts of a source count once, so that copies of one text are no spike.  The histogram has a row per source,
    encoding and length; it is built with map-side combining on numbers, and no task sees more than one source's histogram.
    """
    kind = F.when(F.col("ending") == "cut", 0).when(F.col("ending") == "open", 1).otherwise(2)
    each = rows.filter("ending is not null").select("tab", "source", "digest", kind.alias("kind"), *[F.col("sizes")[i].alias(f"s{i}") for i in range(len(ENCODINGS))])
    once = each.groupBy("tab", "source", "digest").agg(F.min("kind").alias("kind"), *[F.min(f"s{i}").alias(f"s{i}") for i in range(len(ENCODINGS))])
    once = once.select("tab", "source", "kind", F.array(*[f"s{i}" for i in range(len(ENCODINGS))]).alias("sizes"))
    counts = {"texts": F.lit(True), "stopped": F.col("kind") == 0, "open": F.col("kind") == 1, "whole": F.col("kind") == 2}
    hist = _by_encoding(once, "tab", "source", "kind").groupBy("tab", "source", "encoding", "size").agg(*[F.count_if(c).alias(k) for k, c in counts.items()])
    total = hist.groupBy("tab", F.lit("*").alias("source"), "encoding", "size").agg(*[F.sum(k).alias(k) for k in counts])
    near = W.partitionBy("tab", "source", "encoding").orderBy("size").rangeBetween(-AROUND, AROUND)
    both = hist.unionByName(total)
    both = both.select("*", *[((F.sum(k).over(near) - F.col(k)) / (2 * AROUND)).alias(f"around_{k}") for k in counts])
    rate = F.greatest("around_texts", F.lit(0.5))
    ratio = F.col("texts") * F.log(F.col("texts") / rate) - (F.col("texts") - rate)
    excess = F.col("texts") - F.col("around_texts")
    spike = (F.col("texts") > rate) & (ratio >= LIKELY) & (F.col("stopped") - F.col("around_stopped") >= MOSTLY * excess) & (F.col("size") >= 40)
    sure = lambda k: (F.col(k) > 0) & (F.col(f"around_{k}") <= (1 - SURE) * F.col(k))
    own = both.filter(spike).select("tab", "source", "encoding", "size", "texts", "stopped", excess.alias("excess"), sure("open").alias("open_cut"), sure("whole").alias("whole_cut"), F.lit(True).alias("own"))
    shared = own.filter("source = '*'").select("tab", "encoding", "size", "excess", "open_cut", "whole_cut")
    stops = hist.filter("stopped > 0").select("tab", "source", "encoding", "size", "texts", "stopped")
    return own.unionByName(stops.join(shared, ["tab", "encoding", "size"]).withColumn("own", F.lit(False)))


def named_limits(limit: DataFrame) -> DataFrame:
    """``(tab, source, limits)``: the limits of each source, largest excess first, each length under the plainest encoding that shows it nearly best."""
    limit = limit.filter("own")
    top = limit.groupBy("tab", "source", "size").agg(F.max("excess").alias("top"))
    best = limit.join(top, ["tab", "source", "size"]).filter("excess >= 0.95 * top").groupBy("tab", "source", "size").agg(F.min("encoding").alias("encoding"), F.max("excess").alias("excess"))
    name = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, ENCODINGS)), F.col("encoding") + 1), F.col("size").cast("string"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("excess", (-F.col("size")).alias("order"), name.alias("name"))), asc=False), lambda x: x["name"])
    return best.groupBy("tab", "source").agg(F.array_join(listed, "; ").alias("limits"))


def cut_keys(rows: DataFrame, limit: DataFrame) -> DataFrame:
    """``(tab, row_key)`` of the cut texts among measured ``rows``, given their ``limits``.

    The limits of a source come as one array, so that no text is repeated for its encodings.
    """
    held = limit.filter("(open_cut or whole_cut) and source <> '*'").groupBy("tab", "source").agg(F.collect_list(F.struct("encoding", "size", "open_cut", "whole_cut")).alias("held"))
    rest = rows.filter("ending in ('open', 'whole')").join(held, ["tab", "source"])
    decides = lambda x: (F.get("sizes", x["encoding"]) == x["size"]) & F.when(F.col("ending") == "open", x["open_cut"]).otherwise(x["whole_cut"])
    at_limit = rest.filter(F.exists("held", decides)).select("tab", "row_key")
    return rows.filter("ending = 'cut'").select("tab", "row_key").unionByName(at_limit).distinct()


def cut(texts: DataFrame) -> DataFrame:
    """``(tab, row_key)`` of the cut texts among ``texts (tab, row_key, source, text)``."""
    scratch = Scratch(texts.sparkSession, "cut")
    rows = scratch.keep(measured(texts))
    return cut_keys(rows, scratch.keep(limits(rows)))


def catalogue(source_api: Column) -> Column:
    """The catalogue's name in lower case; names joined with ``+`` in alphabetical order."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(F.split(F.lower(source_api), "\\+"), lambda x: F.trim(x)))), "+")


def texts_of(recs: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Abstracts and quotes in one form; a quote belongs to the catalogue of its source (null if that isn't known)."""
    a = recs.select(F.lit("recs").alias("tab"), F.col("rec_id").cast("string").alias("row_key"), catalogue(F.col("source_api")).alias("source"), F.col("abstract").alias("text"))
    api = sources.select(F.col("id").alias("_id"), catalogue(F.col("source_api")).alias("_api")).groupBy("_id").agg(F.min("_api").alias("_api"))
    e = evidence.select("id", "source", "quote").join(api, F.col("source") == F.col("_id"), "left")
    b = e.select(F.lit("evidence").alias("tab"), F.col("id").alias("row_key"), F.col("_api").alias("source"), F.col("quote").alias("text"))
    return a.unionByName(b)


def found(recs: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """``(tab, row_key)`` of every cut abstract and quote."""
    return cut(texts_of(recs, evidence, sources))


def shares(recs: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """``(tab, catalogue, texts, cut_texts, share, limits)``: how often each catalogue's texts are cut, by distinct key, and at which lengths.

    Names joined with ``+`` count for each catalogue; ``limits`` are those of the catalogue's own texts, as ``encoding size``, and null without any.
    """
    scratch = Scratch(recs.sparkSession, "cut")
    rows = scratch.keep(measured(texts_of(recs, evidence, sources)))
    limit = scratch.keep(limits(rows))
    keys = rows.filter("ending is not null").select("tab", "row_key", F.when(F.col("source") == "", "unknown").otherwise(F.col("source")).alias("source")).distinct()
    flagged = keys.join(cut_keys(rows, limit).withColumn("hit", F.lit(1)), ["tab", "row_key"], "left")
    each = flagged.withColumn("catalogue", F.explode(F.split("source", "\\+")))
    out = each.groupBy("tab", "catalogue").agg(F.count(F.lit(1)).alias("texts"), F.count("hit").alias("cut_texts"))
    out = out.withColumn("share", F.round(F.col("cut_texts") / F.col("texts"), 6))
    return out.join(named_limits(limit).withColumnRenamed("source", "catalogue"), ["tab", "catalogue"], "left")
