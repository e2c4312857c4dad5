"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab


def present(col: Column) -> Column:
    """Neither null nor empty."""
    return col.isNotNull() & (col != "")


def numbers_in(text: Column) -> Column:
    """The figures a text asserts, in order; a percent sign is part of its figure.

    Citation ids, numbers of tables, figures, sections, pages, chapters and references, and digits inside words don't count.
    Null and empty texts have none.
    """
    s = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)\[(?:S|E|CL|V|C)\d+\]", " ")
    s = F.regexp_replace(s, vocab.NUMBERED_PLACE, " ")
    s = F.regexp_replace(s, r",(?=\d{3}(?!\w))", "")
    s = F.lower(F.regexp_replace(s, r"(?i)\s*(?:percent|per cent|pct\.?)", "%"))
    return F.transform(F.regexp_extract_all(s, F.lit(r"(?<![\p{L}\d._-])\d+(?:\.\d+)?(?:\s*%)?"), F.lit(0)), lambda x: F.regexp_replace(x, r"\s+", ""))


def numbers_missing(summary: Column, quote: Column) -> Column:
    """Figures of ``summary`` that ``quote`` doesn't hold; ``45%`` in the quote licenses ``45``, ``45`` doesn't license ``45%``."""
    held = numbers_in(quote)
    bare = F.transform(held, lambda x: F.regexp_replace(x, "%$", ""))
    return F.array_distinct(F.filter(numbers_in(summary), lambda x: ~F.array_contains(held, x) & (x.endswith("%") | ~F.array_contains(bare, x))))


def from_inverted_index(index: Column) -> Column:
    """The text of a map from words to positions; null for a null or empty index."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(F.filter(F.coalesce(e["value"], F.array().cast("array<int>")), lambda p: p.isNotNull()), lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.when(F.size(pairs) > 0, F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "))


def _latin_folding() -> tuple[str, str]:
    """Accented Latin letters in lower case and their base letters, by Unicode decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(a, b[0]) for a, b in pairs if len(b) > 1 and b[0].isascii() and b[0].isalpha() and a == a.lower()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    """Lower case without accents (Latin letters; combining marks are dropped)."""
    a, b = _latin_folding()
    return F.regexp_replace(F.translate(F.lower(text), a, b), "[\\u0300-\\u036f]", "")


def tokens(text: Column) -> Column:
    """The distinct content words: at least three letters or digits, no stop word."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", " "), r"\s+")
    return F.array_except(F.array_distinct(F.filter(words, lambda w: F.length(w) > 2)), F.array(*map(F.lit, vocab.STOP_WORDS)))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard overlap of two arrays of distinct words; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def normalised(text: Column) -> Column:
    """Single spaces, no list bullet in front, no space before punctuation."""
    s = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^[-*•\s]+", "")
    return F.trim(F.regexp_replace(s, r"\s+([,.;:])", "$1"))


def plain_markup(text: Column) -> Column:
    """Text without tags: scripts and styles dropped, block ends as line breaks, named entities decoded, spaces collapsed."""
    s = F.regexp_replace(text, r"(?is)<(script|style).*?</\1>", " ")
    s = F.regexp_replace(s, r"(?i)</(p|div|section|h[1-6]|li|tr|br)>|<br\s*/?>", "\n")
    s = F.regexp_replace(s, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        s = F.replace(s, F.lit(entity), F.lit(char))
    codes = F.array_distinct(F.regexp_extract_all(s, F.lit(r"&#(\d{1,7});"), F.lit(1)))
    s = F.aggregate(codes, s, lambda acc, c: F.replace(acc, F.concat(F.lit("&#"), c, F.lit(";")), F.char(c.cast("int"))))
    s = F.regexp_replace(F.regexp_replace(s, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"(?m)^[ \t]+|[ \t]+$", ""), r"^\s+|\s+$", ""))


def article_text(xml: Column) -> Column:
    """The body of a journal article in XML: no reference list, tables marked as left out, titles as headings."""
    body = F.regexp_extract(xml, r"(?is)<body.*?</body>", 0)
    s = F.when(body == "", xml).otherwise(body)
    s = F.regexp_replace(s, r"(?is)<ref-list.*?</ref-list>", " ")
    s = F.regexp_replace(s, r"(?is)<table-wrap.*?</table-wrap>", "\n[table omitted]\n")
    s = F.regexp_replace(F.regexp_replace(s, r"(?i)<title>", "\n\n## "), r"(?i)</title>", "\n")
    return plain_markup(F.regexp_replace(s, r"(?i)</(p|sec|abstract)>", "\n\n"))


def clean_abstract(text: Column) -> Column:
    """Tags to spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"\s+", " "))


def redacted(url: Column) -> Column:
    """The URL with the value of ``api_key`` hidden."""
    return F.regexp_replace(url, r"(?i)([?&]api_key=)[^&]*", "$1<redacted>")


def citations(text: Column) -> Column:
    """The distinct ids a text cites, in the form ``[S12]``."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(vocab.CITATION), F.lit(1)))


def prose(report: Column) -> Column:
    """A report without fenced code, comments and all that follows its reference heading."""
    s = F.regexp_replace(report, r"(?s)```.*?```", "\n")
    s = F.regexp_replace(s, r"(?s)<!--.*?-->", " ")
    return F.element_at(F.split(s, "(?im)^" + vocab.REFERENCES_HEADING + "$"), 1)


def has_figure(paragraph: Column) -> Column:
    """Whether a paragraph states a figure: a percentage, or two digits and more that are no year."""
    s = F.regexp_replace(paragraph, vocab.CITATION, " ")
    return s.rlike(r"(?<![\p{L}\d._-])\d+(?:[.,]\d+)?\s*%") | F.regexp_replace(s, r"(?<!\w)(19|20)\d{2}(?!\w)", " ").rlike(r"(?<![\p{L}\d._-])\d{2,}(?![\d\p{L}-])")


def memory_refusal(text: Column) -> Column:
    """Whether a short answer declines to remember anything."""
    t = F.trim(F.regexp_replace(F.lower(text), "[.!…]+$", ""))
    declined = F.lit(False)
    for p in vocab.REFUSALS:
        declined = declined | t.rlike(p)
    return t.isin(*vocab.BLANK_ENTRIES) | (F.length(t) <= vocab.REFUSAL_CHARS) & declined
