"""Exact set-similarity join: classes of equal sets, prefix filtering, verification.

Equal sets are collapsed into classes first, so copies never pair with each other.  A set of n words can only reach
similarity t with another if they share one of their n - ceil(t n) + 1 rarest words; candidates are joined on those alone,
with a bound on the sizes, and verified exactly.  The result is one row per item, not a list of pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Scratch
from .connected import connect
from .skew import HOT_ROWS, salted_lookup, salted_pairs


def _classes(items: DataFrame, words: Column, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``(id, k, words)`` of items with a set that isn't empty, and ``(k, class_id, members, words)`` of each distinct set."""
    sets = items.select("id", F.array_sort(words).alias("words")).filter(F.size("words") > 0).select("id", F.md5(F.array_join("words", " ")).alias("k"), "words")
    sets = scratch.keep(sets)
    return sets, scratch.keep(sets.groupBy("k").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("members"), F.first("words").alias("words")))


def _prefixes(sets: DataFrame, df: DataFrame, key: str, threshold: float, counted: str | None = None) -> DataFrame:
    """``(key, n, place, w)``: the words of each set's prefix, the rarest first, and their places in it; ``counted`` says that ``df`` counts these sets."""
    each = sets.select(key, F.size("words").alias("n"), F.explode("words").alias("w"))
    ranked = salted_lookup(each, df, ["w"], key, "left", counted=counted).groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "w"))).alias("ws"))
    size = (F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).cast("int")
    return ranked.select(key, "n", F.posexplode(F.slice("ws", F.lit(1), size)).alias("place", "x")).select(key, "n", "place", "x.w")


def _can_reach(threshold: float, na: Column, nb: Column, at_a: Column, at_b: Column) -> Column:
    """Whether sets of these sizes that share a word at these places (the rarest first) can be that similar: the sizes, and the words that still follow."""
    most = 1 + F.least(na - at_a, nb - at_b) - 1 + F.least(at_a, at_b)
    return (F.least(na, nb) >= threshold * F.greatest(na, nb) - 1e-9) & (most >= threshold / (1 + threshold) * (na + nb) - 1e-9)


def _pairs(classes: DataFrame, threshold: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(a, b, ma, mb, ua, ub, both)`` of classes at least that similar, a < b.

    Different sets can only be that similar if the smaller has t / (1 - t) words, so shorter ones are left out.  A word that many prefixes share is salted.
    """
    long = classes.filter(F.size("words") * (1 - threshold) >= threshold - 1e-9)
    df = classes.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    prefix = _prefixes(long, df, "class_id", threshold, "df")
    a = prefix.select(F.col("class_id").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), "w")
    b = prefix.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), "w")
    on = (F.col("a") < F.col("b")) & _can_reach(threshold, F.col("na"), F.col("nb"), F.col("pa"), F.col("pb"))
    pairs = salted_pairs(a, b, ["w"], "a", on, hot_rows).select("a", "b").distinct()
    wa, wb = classes.select(F.col("class_id").alias("a"), F.col("words").alias("ua"), F.col("members").alias("ma")), classes.select(F.col("class_id").alias("b"), F.col("words").alias("ub"), F.col("members").alias("mb"))
    checked = pairs.join(wa, "a").join(wb, "b").withColumn("both", F.size(F.array_intersect("ua", "ub")))
    return checked.filter(_similar(threshold))


def _similar(threshold: float) -> Column:
    return F.col("both") >= threshold * (F.size("ua") + F.size("ub") - F.col("both")) - 1e-9


def linked(items: DataFrame, words: Column, threshold: float = 0.8, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(id, class_id, links)`` for ``items (id, ...)``: the class of equal sets and how many other items are at least that similar.

    Items with an empty set are left out; ``class_id`` is the smallest id of the class.
    """
    scratch = Scratch(items.sparkSession, "similarity")
    sets, classes = _classes(items, words, scratch)
    good = _pairs(classes, threshold, hot_rows)
    ends = good.select(F.explode(F.array(F.struct(F.col("a").alias("class_id"), F.col("mb").alias("m")), F.struct(F.col("b").alias("class_id"), F.col("ma").alias("m")))).alias("x")).select("x.*")
    links = ends.groupBy("class_id").agg(F.sum("m").alias("m"))
    table = classes.join(links, "class_id", "left").select("k", "class_id", "members", (F.col("members") - 1 + F.coalesce("m", F.lit(0))).alias("links"))
    return salted_lookup(sets.select("id", "k"), table, ["k"], "id", counted="members").select("id", "class_id", "links")


def folded(items: DataFrame, words: Column, same: float, near: float) -> DataFrame:
    """``(id, group_id, near)``: items at least ``same`` similar, directly or through others, share the smallest id of them.

    ``near`` counts the other items of a similarity from ``near`` to below ``same``.  Items with an empty set are left out.
    """
    scratch = Scratch(items.sparkSession, "folded")
    sets, classes = _classes(items, words, scratch)
    pairs = scratch.keep(_pairs(classes, near).select("a", "b", "ma", "mb", _similar(same).alias("same")))
    groups = connect(pairs.filter("same").select("a", "b"), scratch=scratch).withColumnRenamed("id", "class_id")
    ends = pairs.filter("not same").select(F.explode(F.array(F.struct(F.col("a").alias("class_id"), F.col("mb").alias("m")), F.struct(F.col("b").alias("class_id"), F.col("ma").alias("m")))).alias("x")).select("x.*")
    table = classes.join(groups, "class_id", "left").join(ends.groupBy("class_id").agg(F.sum("m").alias("near")), "class_id", "left")
    table = table.select("k", "members", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("near", F.lit(0)).alias("near"))
    return salted_lookup(sets.select("id", "k"), table, ["k"], "id", counted="members").select("id", "group_id", "near")


def like_any(items: DataFrame, stored: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``(id)`` of ``items (id, words)`` at least that similar to some row of ``stored (words)``; arrays of distinct words, empty ones match nothing.

    Equal sets on either side are one class.  A class can only be similar to another if their prefixes of n - ceil(t n) + 1 words share a word, in an order that
    puts the words rare among the stored first; candidates are joined on those words and compared by their whole sets.
    """
    scratch = Scratch(items.sparkSession, "like_any")

    def classes(rows: DataFrame) -> DataFrame:
        return rows.select(F.array_sort("words").alias("words")).filter(F.size("words") > 0).distinct().select(F.md5(F.array_join("words", " ")).alias("k"), "words")

    new = scratch.keep(items.select("id", F.array_sort("words").alias("words")).filter(F.size("words") > 0).select("id", F.md5(F.array_join("words", " ")).alias("k"), "words"))
    a, b = scratch.keep(classes(new)), scratch.keep(classes(stored))
    df = scratch.keep(b.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df")))

    x, y = _prefixes(a, df, "k", threshold), _prefixes(b, df, "k", threshold).select(F.col("k").alias("k2"), F.col("n").alias("n2"), F.col("place").alias("place2"), "w")
    pairs = salted_pairs(x, y, ["w"], "k", _can_reach(threshold, F.col("n"), F.col("n2"), F.col("place"), F.col("place2"))).select("k", "k2").distinct()
    both = pairs.join(a.select("k", F.col("words").alias("ua")), "k").join(b.select(F.col("k").alias("k2"), F.col("words").alias("ub")), "k2").withColumn("both", F.size(F.array_intersect("ua", "ub")))
    return new.select("id", "k").join(both.filter(_similar(threshold)).select("k").distinct(), "k", "left_semi").select("id")
