"""Append-only decisions as latest state, and the counts derived from them.

Null handling throughout: a decision without source or reviewer is left out; group keys that are null count under the
name the argument gives; empty tables give zero counts, or no rows where the result is one row per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import present
from .skew import salted_lookup


def clean_verdict(verdict: Column) -> Column:
    return F.lower(F.regexp_replace(verdict, "^[\\s\\p{IsWhite_Space}]+|[\\s\\p{IsWhite_Space}]+$", ""))


def latest_verdicts(screening: DataFrame) -> DataFrame:
    """The last decision of each reviewer on each source, by the order of the log; combined on the map side."""
    rows = screening.filter("source is not null and reviewer is not null")
    last = rows.groupBy("source", "reviewer").agg(F.max_by(F.struct(clean_verdict(F.col("verdict")).alias("verdict"), "reason", "stage", "seq"), "seq").alias("x"))
    return last.select("source", "reviewer", "x.verdict", "x.reason", "x.stage", "x.seq")


def included_sources(sources: DataFrame, latest: DataFrame, reviewer: str = "pass1") -> DataFrame:
    """Sources whose last decision by ``reviewer`` is include."""
    return sources.join(latest.filter((F.col("reviewer") == reviewer) & (F.col("verdict") == "include")).select(F.col("source").alias("id")), "id", "left_semi")


def dual_review(latest: DataFrame, first: str = "pass1", second: str = "pass2") -> DataFrame:
    """``(source, verdict_1, verdict_2, conflict)`` for sources decided by both."""
    a = latest.filter(F.col("reviewer") == first).select("source", F.col("verdict").alias("verdict_1"))
    b = latest.filter(F.col("reviewer") == second).select("source", F.col("verdict").alias("verdict_2"))
    return a.join(b, "source").withColumn("conflict", ~F.col("verdict_1").eqNullSafe(F.col("verdict_2")))


def agreement(latest: DataFrame) -> DataFrame:
    """One row: sources decided twice, conflicts, and agreement in whole percent (null without any)."""
    one = dual_review(latest).agg(F.count(F.lit(1)).alias("double_screened"), F.count_if("conflict").alias("conflicts"))
    return one.withColumn("agreement_pct", F.round(F.try_divide((F.col("double_screened") - F.col("conflicts")) * 100, F.col("double_screened"))).cast("bigint"))


def funnel(sources: DataFrame, latest: DataFrame, reviewer: str = "pass1") -> DataFrame:
    """One row of counts from identified to included: one pass over each table."""
    read, met = F.col("read_at").isNotNull(), present(F.col("metadata_at"))
    a = sources.agg(
        F.count(F.lit(1)).alias("identified"), F.count_if(met & ~read).alias("metadata_only"), F.count_if(read).alias("read"),
        F.count_if(read & ~F.coalesce(F.col("read_scope") == "abstract", F.lit(False))).alias("read_fulltext"), F.count_if(~F.coalesce(met, F.lit(False))).alias("unfetched"),
    )
    p = latest.filter(F.col("reviewer") == reviewer)
    b = p.agg(F.count(F.lit(1)).alias("screened"), F.count_if(F.col("verdict") == "exclude").alias("excluded"), F.count_if(F.col("verdict") == "include").alias("included"))
    return a.crossJoin(b).withColumn("unscreened", F.col("identified") - F.col("screened"))  # one row each


def funnel_by_stage(latest: DataFrame, reviewer: str = "pass1") -> DataFrame:
    p = latest.filter(F.col("reviewer") == reviewer)
    return p.groupBy(F.coalesce("stage", F.lit("unknown")).alias("stage")).agg(F.count(F.lit(1)).alias("screened"), F.count_if(F.col("verdict") == "exclude").alias("excluded"), F.count_if(F.col("verdict") == "include").alias("included"))


def histogram(rows: DataFrame, key: Column, name: str, missing: str = "unknown") -> DataFrame:
    """``(name, n)``; null keys count under ``missing``."""
    return rows.groupBy(F.coalesce(key.cast("string"), F.lit(missing)).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def dense_histogram(rows: DataFrame, key: str, vocabulary: Sequence[str]) -> DataFrame:
    """``(key, n)`` with a row for each word of the vocabulary, 0 where there is none."""
    words = rows.sparkSession.createDataFrame([(w,) for w in vocabulary], f"{key} string")
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return words.join(counted, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def exclusions(latest: DataFrame, reviewer: str = "pass1") -> DataFrame:
    p = latest.filter((F.col("reviewer") == reviewer) & (F.col("verdict") == "exclude") & present(F.col("reason")))
    return p.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def exclude_streaks(screening: DataFrame, part_rows: int = 100_000) -> DataFrame:
    """``(reviewer, longest)``: the longest run of consecutive excludes in each reviewer's log.

    A reviewer's log is cut into stretches of ``seq``, as many as the counted rows need, so that no task holds the whole log of one.
    Each stretch gives its number of rows, the run at its head, the run at its tail and its longest run; runs that cross stretches are put
    together from these few rows.  Rows of equal ``seq`` are ordered by their verdict, others before excludes; rows without a reviewer or ``seq`` are left out.
    """
    x = F.coalesce(clean_verdict(F.col("verdict")) == "exclude", F.lit(False))
    rows = screening.filter("reviewer is not null and seq is not null").select("reviewer", "seq", x.alias("x"))
    held = rows.groupBy("reviewer").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high"))
    wide = held.select("reviewer", "n", "low", F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low") + 1) / F.ceil(F.col("n") / part_rows))).cast("bigint").alias("width"))
    part = F.floor((F.col("seq") - F.col("low")) / F.col("width"))
    rows = salted_lookup(rows, wide, ["reviewer"], "seq", counted="n").select("reviewer", "seq", "x", part.alias("part"))
    w = W.partitionBy("reviewer", "part").orderBy("seq", "x")
    run = F.row_number().over(w) - F.sum(F.col("x").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    # ``run`` counts the rows before that are no excludes: 0 at the head of the stretch, all of them at its tail
    islands = rows.withColumn("run", run).groupBy("reviewer", "part", "run").agg(F.count_if("x").alias("n"), F.count_if(~F.col("x")).alias("others"))
    ends = islands.groupBy("reviewer", "part").agg(
        F.sum("others").alias("others"), F.max("n").alias("longest"), F.max(F.when(F.col("run") == 0, F.col("n")).otherwise(0)).alias("head"), F.max_by("n", "run").alias("tail"),
    )
    # a run across stretches: the tail of one, all stretches without another verdict after it, the head of the next
    w = W.partitionBy("reviewer").orderBy("part")
    ends = ends.withColumn("chain", F.sum((F.col("others") > 0).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1)))
    pieces = ends.select("reviewer", "longest", F.explode(F.array(
        F.struct(F.coalesce("chain", F.lit(0)).alias("chain"), F.col("head").alias("n")),
        F.struct((F.coalesce("chain", F.lit(0)) + 1).alias("chain"), F.when(F.col("others") > 0, F.col("tail")).otherwise(0).alias("n")),
    )).alias("p"))
    chains = pieces.groupBy("reviewer", "p.chain").agg(F.sum("p.n").alias("n"), F.max("longest").alias("longest"))
    longest = chains.groupBy("reviewer").agg(F.greatest(F.max("n"), F.max("longest")).alias("longest"))
    return longest.filter("longest > 0")


def saturation(events: DataFrame, key: Column, round_: Column) -> DataFrame:
    """``(round, seen, novel, ratio)``: the share of keys that no earlier round had."""
    first = events.select(key.alias("key"), round_.alias("round")).filter("key is not null and round is not null").distinct()
    start = first.groupBy("key").agg(F.min("round").alias("start"))
    joined = first.join(start, "key")
    out = joined.groupBy("round").agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("round") == F.col("start")).alias("novel"))
    return out.withColumn("ratio", F.round(F.col("novel") / F.col("seen"), 6))
