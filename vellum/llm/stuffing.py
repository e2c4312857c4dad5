"""Keyword-stuffed and link-list pages (problem 9): rank-frequency curves per page, fitted with SQL windows.

A page's words are counted within its row, on sorted 64-bit hashes, so no text and no list of words is shuffled.  What is shuffled is each page's
spectrum, how many of its words occur how often, a handful of numbers; windows over it give the ranks, and from them come

* the slope and the residual of a line through log frequency over log rank (words of equal frequency share their mean rank),
* the page's own curve: the share of its words that its RANKS most frequent words make up,
* the curve of prose on the page: the share that the PROSE_RANKS words found on most pages of its language make up.

Each page is compared with the pages of its language at comparable lengths: every figure is expressed in interquartile ranges from the median of its
class, and the quartiles come from histograms over all pages.  The divergence is the mean excess of the page's own curve plus the mean deficit of the prose curve.  A page is
flagged where its divergence exceeds DIVERGENT, or LEANING together with an extreme slope or residual.

Defined results: null and empty texts and pages with fewer than LEAST_WORDS words are no cases; a page is compared with the language whose words
make up most of it, or that of its label where none do; a ``doc_id`` of several rows is a case if any of them is; equal pages are judged alike; a
null ``doc_id`` is left out; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import Scratch

LEAST_WORDS = 12
#: Ranks up to which the curves are taken.
RANKS, PROSE_RANKS = (1, 2, 4, 8, 16, 32, 64, 128, 256), (1, 2, 4, 8, 16, 32, 40)
BASE = PROSE_RANKS[-1]
#: A class takes in the lengths around it, in half powers of two, until it has this many pages; beyond the last width, its whole language.
CLASS_PAGES, WIDTHS = 20, (1, 2, 4, 64)
#: Bounds in interquartile ranges: the divergence by itself, or with an extreme slope or residual.
DIVERGENT, LEANING, STEEP, LOOSE = 2.5, 2.0, 3.0, 4.0
#: Width of a histogram's bins, and the least interquartile range.
BIN, LEAST_RANGE = 1 / 512, 1 / 256

_OWN = [f"own{r}" for r in RANKS]
_PROSE = [f"prose{r}" for r in PROSE_RANKS]
_FIGURES = ["slope", "residual", *_OWN, *_PROSE]


def words(text: Column) -> Column:
    """Words of letters in lower case (and empty strings at the ends); the names of tags don't count."""
    bare = F.when(text.contains("<"), F.regexp_replace(text, "</?[A-Za-z][A-Za-z0-9]*", " ")).otherwise(text)
    return F.split(F.lower(bare), "[^\\p{L}\\p{M}]+")


def counted(documents: DataFrame) -> DataFrame:
    """``(page, doc_id, lang, n, words, counts)`` of each row with enough words: its distinct words (hashed, in order) and how often each occurs.

    Equal hashes stand side by side once sorted, so the ends of their runs give the counts.  ``page`` is unique; write the result before use.
    """
    rows = documents.filter("doc_id is not null and text is not null and text <> ''").select("doc_id", F.when(F.col("lang").isNotNull(), F.xxhash64("lang")).alias("lang"), words(F.col("text")).alias("w"))
    rows = rows.select("doc_id", "lang", F.sort_array(F.transform(F.array_remove("w", ""), lambda x: F.xxhash64(x))).alias("h")).withColumn("n", F.size("h")).filter(F.col("n") >= LEAST_WORDS)
    ends = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: (i == F.col("n")) | (F.get("h", i) != F.get("h", i - 1)))
    rows = rows.select("doc_id", "lang", "n", "h", ends.alias("ends"))
    counts = F.transform("ends", lambda i, k: (i - F.when(k == 0, 0).otherwise(F.get("ends", k - 1))).cast("int"))
    return rows.select(F.monotonically_increasing_id().alias("page"), "doc_id", "lang", "n", F.transform("ends", lambda i: F.get("h", i - 1)).alias("words"), counts.alias("counts"))


def pages(rows: DataFrame) -> DataFrame:
    """``(page, v, slope, residual, own...)``: the fitted curve of each page of ``counted`` rows."""
    sizes = rows.select("page", F.size("counts").alias("v"), F.sort_array("counts", asc=False).alias("f"))
    ends = F.filter(F.sequence(F.lit(1), F.col("v")), lambda i: (i == F.col("v")) | (F.get("f", i) != F.get("f", i - 1)))
    sizes = sizes.select("page", "f", ends.alias("ends"))
    runs = F.transform("ends", lambda i, k: F.struct(F.get("f", i - 1).alias("f"), (i - F.when(k == 0, 0).otherwise(F.get("ends", k - 1))).cast("int").alias("m")))
    spectrum = sizes.select("page", F.explode(runs).alias("x")).select("page", "x.f", "x.m")
    above = F.coalesce(F.sum("m").over(W.partitionBy("page").orderBy(F.desc("f")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = spectrum.withColumn("above", above)
    x, y, m = F.log(F.col("above") + (F.col("m") + 1) / 2), F.log(F.col("f").cast("double")), F.col("m")
    held = lambda r: F.sum(F.col("f") * F.least(m, F.greatest(F.lit(r) - F.col("above"), F.lit(0))))
    total, v = F.sum(F.col("f").cast("bigint") * m), F.sum("m")
    sums = ranked.groupBy("page").agg(
        v.alias("v"), (F.sum(m * x) / v).alias("mx"), (F.sum(m * y) / v).alias("my"), (F.sum(m * x * x) / v).alias("xx"), (F.sum(m * x * y) / v).alias("xy"), (F.sum(m * y * y) / v).alias("yy"),
        *[(held(r) / total).alias(f"own{r}") for r in RANKS],
    )
    sxx, sxy, syy = F.col("xx") - F.col("mx") ** 2, F.col("xy") - F.col("mx") * F.col("my"), F.col("yy") - F.col("my") ** 2
    slope = F.when(sxx > 1e-12, sxy / sxx).otherwise(0.0)
    return sums.select("page", "v", slope.alias("slope"), F.sqrt(F.greatest(syy - slope * sxy, F.lit(0.0))).alias("residual"), *_OWN)


def base_words(rows: DataFrame) -> DataFrame:
    """``(base_lang, word, rank)``: the BASE words on most pages of each language, by label."""
    seen = rows.filter("lang is not null").select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("df"))
    top = seen.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("df"), "word"))).filter(F.col("rank") <= BASE)
    return top.select(F.col("lang").alias("base_lang"), "word", "rank")


def prose_curve(rows: DataFrame, base: DataFrame) -> DataFrame:
    """``(page, base_lang, held...)``: how many of a page's words are prose words of each language up to each rank; only languages with any."""
    each = rows.select("page", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("page", F.col("x.words").alias("word"), F.col("x.counts").alias("f"))
    return each.join(base, "word").groupBy("page", "base_lang").agg(*[F.sum(F.when(F.col("rank") <= r, F.col("f")).otherwise(0)).cast("int").alias(f"held{r}") for r in PROSE_RANKS])


def features(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``(page, doc_id, base_lang, n, size_class, slope, residual, own..., prose...)`` of each page."""
    held = prose_curve(rows, scratch.keep(base_words(rows)))
    last = f"held{BASE}"
    best = held.withColumn("r", F.row_number().over(W.partitionBy("page").orderBy(F.desc(last), "base_lang"))).filter("r = 1").drop("r")
    both = rows.select("page", "doc_id", "lang", "n").join(pages(rows), "page").join(best, "page", "left")
    return both.select(
        "page", "doc_id", F.coalesce("base_lang", "lang", F.lit(0)).alias("base_lang"), "n", F.floor(2 * F.log2("n")).cast("int").alias("size_class"), "slope", "residual", *_OWN,
        *[(F.coalesce(f"held{r}", F.lit(0)) / F.col("n")).alias(f"prose{r}") for r in PROSE_RANKS],
    )


def quartiles(rows: DataFrame) -> DataFrame:
    """``(base_lang, size_class, q)``: the quartiles of all figures of each class, ``q`` an array of (low, middle, high) in the order of the figures.

    They are read off histograms, which are counted with map-side combining; a class with few pages takes in its neighbours first.
    """
    bins = F.array(*[F.floor(F.col(c) / BIN).cast("int") for c in _FIGURES])
    hist = rows.select("base_lang", "size_class", F.posexplode(bins).alias("figure", "bin")).groupBy("base_lang", "size_class", "figure", "bin").agg(F.count(F.lit(1)).alias("c"))
    held = hist.filter("figure = 0").groupBy("base_lang", "size_class").agg(F.sum("c").alias("c"))
    reach = lambda df: df.withColumn("width", F.explode(F.array(*map(F.lit, WIDTHS))))
    targets = reach(held.select("base_lang", F.col("size_class").alias("target")))
    near = targets.join(held, "base_lang").filter(F.abs(F.col("size_class") - F.col("target")) <= F.col("width"))  # classes, not pages: a few dozen of each language
    width = near.groupBy("base_lang", "target", "width").agg(F.sum("c").alias("c")).groupBy("base_lang", "target").agg(F.coalesce(F.min(F.when(F.col("c") >= CLASS_PAGES, F.col("width"))), F.lit(WIDTHS[-1])).alias("width"))
    taken = hist.join(width, "base_lang").filter(F.abs(F.col("size_class") - F.col("target")) <= F.col("width")).groupBy("base_lang", "target", "figure", "bin").agg(F.sum("c").alias("c"))
    w = W.partitionBy("base_lang", "target", "figure")
    ranked = taken.withColumn("upto", F.sum("c").over(w.orderBy("bin"))).withColumn("all", F.sum("c").over(w))
    at = [F.min(F.when(F.col("upto") >= q * F.col("all"), (F.col("bin") + 0.5) * BIN)).alias(k) for q, k in ((0.25, "low"), (0.5, "middle"), (0.75, "high"))]
    each = ranked.groupBy("base_lang", "target", "figure").agg(*at)
    return each.groupBy("base_lang", F.col("target").alias("size_class")).agg(F.transform(F.sort_array(F.collect_list(F.struct("figure", "low", "middle", "high"))), lambda x: F.struct(x["low"].alias("low"), x["middle"].alias("middle"), x["high"].alias("high"))).alias("q"))


def judged(documents: DataFrame, fit: Column | None = None) -> DataFrame:
    """``(page, doc_id, n, divergence, own_excess, prose_deficit, steeper, looser, is_stuffed)`` of each page.

    ``fit`` restricts the pages of which the quartiles are taken, to measure on the others; by default all pages count.
    """
    scratch = Scratch(documents.sparkSession, "stuffing")
    rows = scratch.keep(features(scratch.keep(counted(documents)), scratch))
    classes = scratch.keep(quartiles(rows if fit is None else rows.filter(fit)))  # kept, so that its size is known before pages would be shuffled to it
    both = rows.join(classes, ["base_lang", "size_class"], "left")
    at = {c: i for i, c in enumerate(_FIGURES)}
    q = lambda c, k: F.get(F.col("q"), F.lit(at[c]))[k]
    z = lambda c: F.coalesce((F.col(c) - q(c, "middle")) / F.greatest(q(c, "high") - q(c, "low"), F.lit(LEAST_RANGE)), F.lit(0.0))
    own, prose = sum(z(c) for c in _OWN) / len(_OWN), sum(z(c) for c in _PROSE) / len(_PROSE)
    both = both.select("page", "doc_id", "n", F.greatest(own, F.lit(0.0)).alias("own_excess"), F.greatest(-prose, F.lit(0.0)).alias("prose_deficit"), (-z("slope")).alias("steeper"), z("residual").alias("looser"))
    both = both.withColumn("divergence", F.col("own_excess") + F.col("prose_deficit"))
    extreme = (F.col("steeper") > STEEP) | (F.col("looser") > LOOSE)
    return both.withColumn("is_stuffed", (F.col("divergence") > DIVERGENT) | (F.col("divergence") > LEANING) & extreme)


def found(documents: DataFrame) -> DataFrame:
    """``(doc_id)`` of the pages that are mostly repeated keywords, links or tags."""
    return judged(documents).filter("is_stuffed").select("doc_id").distinct()
