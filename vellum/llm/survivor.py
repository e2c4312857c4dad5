"""The best record of each duplicate group (problem 5): iterative truth discovery over all fields.

Every row makes claims: the values of its fields, in the name of its catalogues.  A value's support is the sum of its claims, each weighed by the
log odds that its catalogue is right; a catalogue's reliability is the share of all its claims that agree with the values chosen.  Both are
estimated alternately until they settle (``tolerance``) or ``iterations`` are done, which is reported as ``converged``.

* ``abstract``: rows with the same letters make the same claim.  A cut text supports each whole text that begins with all of its letters, and
  can't be chosen; nor can placeholders and notices.  The best supported text wins.
* ``citations``: counts only grow, so a lower count is an older one of the same truth and supports the highest valid one; it agrees with it
  as far as it reaches.
* ``source_api``, ``found_by``: sets; a value that any row names is supported by its namers and survives, since all weights are positive.

Claims are summed per group, field, value and catalogue before anything else.  Where no weights can change the choice (a single text, counts, sets), a
claim's agreement is known at once and summed once per catalogue; an iteration runs over the votes of contested texts alone, writes the new
weights and observes how far they moved, so it is one job, and nothing but that number reaches the driver.

A notice is a text in the form of one, or one whose groups bear different titles: at least TITLES of them, and none in half of its groups.  The abstract of a work
that stands in many groups because nothing links them has one title in most of them, and is none.

Defined results: a field without a valid value gives no row; of equally supported texts the longer, then the one with the
smallest row wins; null array entries and empty names are left out; a table without groups gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import salted_lookup
from ..sources import shared
from ..sources.shared import Scratch
from . import components, truncation
from .formatting_dups import stripped

#: A whole abstract has at least WORDS words; a text under TITLES different titles or more may be a notice.
WORDS, TITLES = 8, 3
#: Wordings of notices that stand in place of an abstract; a text of at most NOTICE_WORDS words that has one is a notice.
NOTICE_WORDS = 40
NOTICE = r"(?i)\b(abstract|summary|full text|content)\b[^.]{0,60}\b(un|not )available\b|\bno abstract\b|\bsee (the )?full text\b|\b(use|click|follow) the [^.]{0,40}\b(link|button)\b|\bget access\b"
#: Half a tag or entity at the end of a cut text.
HALF_END = r"(<(/?[A-Za-z][^<>]{0,80}|/)?|&#?\w{0,8})$"
FIELDS = ("abstract", "citations", "source_api", "found_by")


def plain(text: Column) -> Column:
    """Letters and digits alone, in lower case, without mark-up, entities and spacing."""
    text = F.regexp_replace(text, "</?[A-Za-z][^<>]{0,200}>", " ")
    text = F.regexp_replace(text, "&#(37|x25);", "%")
    text = F.regexp_replace(text, "&(#\\d{1,7}|#x[0-9A-Fa-f]{1,6}|\\w{2,8});", " ")
    return F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", "")


def catalogues(source_api: Column) -> Column:
    """The catalogues a row names, in lower case."""
    names = F.transform(F.split(F.lower(source_api), "\\+"), lambda x: F.regexp_replace(x, "^[\\s\\p{IsWhite_Space}]+|[\\s\\p{IsWhite_Space}]+$", ""))
    return F.array_distinct(F.filter(names, lambda x: x.isNotNull() & (x != "")))


def _notices(whole: DataFrame) -> DataFrame:
    """``(value, n)`` of the texts that many different titles share; ``whole (value, group_id, title)``, a missing title counts for nothing."""
    groups = whole.groupBy("value", "group_id").agg(F.count(F.lit(1)).alias("n"), F.min("title").alias("title"))
    titles = groups.groupBy("value", "title").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"))
    held = titles.groupBy("value").agg(F.count("title").alias("titles"), F.max(F.when(F.col("title").isNotNull(), F.col("groups"))).alias("top"), F.sum("groups").alias("groups"), F.sum("n").alias("n"))
    return held.filter((F.col("titles") >= TITLES) & (F.col("top") * 2 < F.col("groups"))).select("value", "n")


def abstract_claims(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``(group_id, rec_id, kind, value, size, source_api)``; ``kind`` is whole or cut, ``value`` a digest of the letters."""
    texts = rows.select(F.lit("recs").alias("tab"), F.col("rec_id").cast("string").alias("row_key"), truncation.catalogue(F.col("source_api")).alias("source"), F.col("abstract").alias("text"))
    cut = truncation.cut(texts).select(F.col("row_key").cast("bigint").alias("rec_id"), F.lit(True).alias("is_cut"))
    words = F.regexp_count("abstract", F.lit("[\\p{L}\\p{N}]+"))
    letters = rows.withColumn("words", words).filter(F.col("abstract").isNotNull() & (F.col("words") >= WORDS)).filter(~((F.col("words") <= NOTICE_WORDS) & F.col("abstract").rlike(NOTICE)))
    title = F.nullif(stripped(F.col("title")), F.lit(""))
    letters = letters.select("group_id", "rec_id", "source_api", plain(F.col("abstract")).alias("p"), F.when(title.isNotNull(), F.xxhash64(title)).alias("title")).filter("p <> ''")
    claims = letters.join(cut, "rec_id", "left").select(
        "group_id", "rec_id", "source_api", F.when(F.col("is_cut"), "cut").otherwise("whole").alias("kind"), F.unhex(F.md5("p")).alias("value"), F.length("p").alias("size"), "title",
    )
    claims = scratch.keep(claims)
    notices = scratch.keep(_notices(claims.filter("kind = 'whole'").select("value", "group_id", "title")))
    return salted_lookup(claims, notices, ["value"], "rec_id", "left_anti", counted="n").drop("title")


def _named(rows: DataFrame) -> DataFrame:
    """A row for each catalogue that ``source_api`` names; one of name '' where it names none."""
    return rows.withColumn("catalogue", F.explode_outer(catalogues(F.col("source_api")))).withColumn("catalogue", F.coalesce("catalogue", F.lit(""))).drop("source_api")


def _abstract_votes(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """Votes on the texts, and those of cut texts; of groups with one whole text the agreement is known, the others are contested."""
    claims = scratch.keep(abstract_claims(rows, scratch))
    whole = claims.filter("kind = 'whole'")
    ends = whole.groupBy("group_id").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n"))
    contested = scratch.keep(ends.filter("low <> high").select("group_id", "n"))
    votes = _named(whole).groupBy("group_id", F.base64("value").alias("value"), "catalogue").agg(F.count(F.lit(1)).alias("n"), F.max("size").cast("bigint").alias("size"), F.min("rec_id").alias("rec_id"))
    if shared.rows(contested):
        open_ = contested.select("group_id", F.col("n").alias("_rows"), F.lit(True).alias("open"))
        votes = salted_lookup(votes, open_, ["group_id"], "value", "left", counted="_rows")
    else:
        votes = votes.withColumn("open", F.lit(None).cast("boolean"))
    votes = votes.select("group_id", F.lit("abstract").alias("field"), "value", "catalogue", "n", "size", "rec_id", F.when(F.col("open").isNull(), F.col("n").cast("double")).alias("agreed"))
    if not shared.rows(contested):
        return votes, None
    # letters again, of the contested groups alone: each distinct whole text against the cut texts of its group
    some = rows.select("rec_id", "abstract")
    first = whole.join(contested.select("group_id"), "group_id", "left_semi").groupBy("group_id", "value").agg(F.min("rec_id").alias("rec_id"), F.max("size").cast("bigint").alias("size"))
    texts = first.join(some, "rec_id").select("group_id", F.base64("value").alias("value"), "size", plain(F.col("abstract")).alias("whole_text"))
    cut = claims.filter("kind = 'cut'").join(contested.select("group_id"), "group_id", "left_semi").select("group_id", "rec_id", "source_api")
    begun = cut.join(some, "rec_id").select("group_id", "source_api", plain(F.regexp_replace("abstract", HALF_END, "")).alias("p")).filter("p <> ''")
    begun = _named(begun).groupBy("group_id", "p", "catalogue").agg(F.count(F.lit(1)).alias("n"))
    backing = begun.join(texts, "group_id").filter(F.startswith("whole_text", F.col("p")))
    backing = backing.groupBy("group_id", "value", "catalogue").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
    return votes, backing.select("group_id", F.lit("abstract").alias("field"), "value", "catalogue", "n", "size", F.lit(None).cast("bigint").alias("rec_id"), F.lit(None).cast("double").alias("agreed"))


def votes(rows: DataFrame, scratch: Scratch, fields: tuple[str, ...] = FIELDS) -> tuple[DataFrame, DataFrame]:
    """``(group_id, field, value, catalogue, n, size, rec_id, agreed)`` of all fields; and the votes of cut texts in the same form.

    ``agreed`` is how much of ``n`` agrees with the choice, null where the choice depends on the weights.
    """
    none = F.lit(None).cast("bigint").alias("rec_id")
    parts, backing = [], None
    if "abstract" in fields:
        own, backing = _abstract_votes(rows, scratch)
        parts.append(own)
    if "citations" in fields:
        counts = rows.filter("citations >= 0").select("group_id", "rec_id", "citations", "source_api")
        best = scratch.keep(counts.groupBy("group_id").agg(F.max("citations").alias("best"), F.count(F.lit(1)).alias("_n")))
        reached = F.when(F.col("best") > 0, F.col("citations") / F.col("best")).otherwise(1.0)
        claims = salted_lookup(counts, best, ["group_id"], "rec_id", counted="_n").select("group_id", "best", reached.alias("reached"), "source_api")
        g = _named(claims).groupBy("group_id", "best", "catalogue").agg(F.count(F.lit(1)).alias("n"), F.sum("reached").alias("agreed"))
        parts.append(g.select("group_id", F.lit("citations").alias("field"), F.col("best").cast("string").alias("value"), "catalogue", "n", F.col("best").cast("bigint").alias("size"), none, "agreed"))
    for field in ("source_api", "found_by"):
        if field in fields:
            values = catalogues(F.col("source_api")) if field == "source_api" else F.filter("found_by", lambda x: x.isNotNull() & (x != ""))
            named = _named(rows.select("group_id", "source_api", F.explode(values).alias("value")))
            if field == "source_api":  # a catalogue names itself
                named = named.filter("catalogue = value")
            g = named.groupBy("group_id", "value", "catalogue").agg(F.count(F.lit(1)).alias("n"))
            parts.append(g.select("group_id", F.lit(field).alias("field"), "value", "catalogue", "n", F.lit(None).cast("bigint").alias("size"), none, F.col("n").cast("double").alias("agreed")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = scratch.keep(out)
    return out, scratch.keep(backing) if backing is not None else out.limit(0)


class Discovery:
    """The chosen values ``(group_id, field, value, rec_id)``, the catalogues' ``weights (catalogue, weight)`` and whether they settled."""

    def __init__(self, chosen: DataFrame, weights: DataFrame, converged: bool):
        self.chosen, self.weights, self.converged = chosen, weights, converged


def discover(rows: DataFrame, fields: tuple[str, ...] = FIELDS, iterations: int = 25, tolerance: float = 1e-3) -> Discovery:
    """Estimate reliability and choose values over the rows of groups, ``(group_id, rec_id, title, abstract, citations, source_api, found_by)``."""
    scratch = Scratch(rows.sparkSession, "survivor")
    own, backing = votes(rows, scratch, fields)
    settled = own.filter("agreed is not null").groupBy("catalogue").agg(F.sum("n").alias("n"), F.sum("agreed").alias("agreed"))
    names = own.groupBy("catalogue").agg(F.count_if(F.col("agreed").isNull()).alias("open"))
    known = scratch.keep(names.join(settled, "catalogue", "left").select("catalogue", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("agreed", F.lit(0.0)).alias("agreed"), "open"), open=F.sum("open"))
    reliability = lambda agreed, n: (agreed + 8.0) / (n + 10.0)
    weights = scratch.keep(known.select("catalogue", reliability(F.col("agreed"), F.col("n")).alias("weight")))
    converged = not shared.measure(known, "open")
    if not converged:
        contested = scratch.keep(own.filter("agreed is null"))
        for _ in range(iterations):
            best = _best(contested.unionByName(backing), weights).select("group_id", F.col("value").alias("best"))
            told = contested.join(best, "group_id").groupBy("catalogue").agg(F.sum("n").alias("m"), F.sum(F.when(F.col("value") == F.col("best"), F.col("n")).otherwise(0)).alias("right"))
            newer = known.join(told, "catalogue", "left").join(weights.withColumnRenamed("weight", "old"), "catalogue")
            weight = reliability(F.col("agreed") + F.coalesce("right", F.lit(0)), F.col("n") + F.coalesce("m", F.lit(0)))
            newer = scratch.keep(newer.select("catalogue", weight.alias("weight"), "old"), moved=F.max(F.abs(F.col("weight") - F.col("old"))))
            scratch.drop(weights)
            weights = newer.select("catalogue", "weight")
            weights._vellum_path = newer._vellum_path
            if converged := (shared.measure(newer, "moved") or 0.0) < tolerance:
                break
        one = _best(contested.unionByName(backing), weights)
    told = _supported(own.filter("agreed is not null"), weights).select("group_id", "field", "value", "rec_id")
    if shared.measure(known, "open"):
        told = told.unionByName(one.select("group_id", F.lit("abstract").alias("field"), "value", "rec_id"))
    return Discovery(told, weights, converged)


def _supported(some: DataFrame, weights: DataFrame) -> DataFrame:
    """Support of each value: the sum of its claims' weights, which are log odds of being right and never below 0.05."""
    odds = F.greatest(F.log(F.col("weight") / (1.02 - F.col("weight"))), F.lit(0.05))
    return some.join(weights, "catalogue").groupBy("group_id", "field", "value").agg(F.sum(F.col("n") * odds).alias("support"), F.max("size").alias("size"), F.min("rec_id").alias("rec_id"))


def _best(contested: DataFrame, weights: DataFrame) -> DataFrame:
    """``(group_id, value, rec_id)``: the best supported text of each contested group."""
    support = _supported(contested, weights).filter("rec_id is not null")
    best = support.groupBy("group_id").agg(F.max(F.struct(F.round("support", 6).alias("support"), "size", (-F.col("rec_id")).alias("first"), "value")).alias("b"))
    return best.select("group_id", F.col("b.value").alias("value"), (-F.col("b.first")).alias("rec_id"))


def members(recs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The rows of groups of two or more, with their ``group_id``; ``groups (rec_id, group_id)`` where they are known already."""
    return recs.select("rec_id", "title", "abstract", "citations", "source_api", "found_by").join(components.groups(recs) if groups is None else groups, "rec_id")


def found(recs: DataFrame, groups: DataFrame | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``(group_id, field, val)``: the surviving value of each field of each group."""
    rows = Scratch(recs.sparkSession, "members").keep(members(recs, groups))
    chosen = discover(rows, fields).chosen
    return chosen.select("group_id", "field", F.when(F.col("field") == "abstract", F.col("rec_id").cast("string")).otherwise(F.col("value")).alias("val"))


def fields(recs: DataFrame) -> DataFrame:
    """``found`` without the abstracts."""
    return found(recs, fields=FIELDS[1:])


def survivors(recs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """One surviving record per group: ``(group_id, rows, abstract_from, abstract, citations, source_api, found_by)``."""
    scratch = Scratch(recs.sparkSession, "members")
    rows = scratch.keep(members(recs, groups))
    chosen = scratch.keep(discover(rows).chosen)
    held = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("rows"))
    value = lambda field: F.when(F.col("field") == field, F.col("value"))
    flat = chosen.groupBy("group_id").agg(
        F.max(F.when(F.col("field") == "abstract", F.col("rec_id"))).alias("abstract_from"), F.max(value("citations").cast("int")).alias("citations"),
        F.array_join(F.array_sort(F.collect_set(value("source_api"))), "+").alias("source_api"), F.array_sort(F.collect_set(value("found_by"))).alias("found_by"),
    )
    out = held.join(flat, "group_id", "left").join(rows.select(F.col("rec_id").alias("abstract_from"), "abstract"), "abstract_from", "left")
    return out.select("group_id", "rows", "abstract_from", "abstract", "citations", F.nullif("source_api", F.lit("")).alias("source_api"), "found_by")
