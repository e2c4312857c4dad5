"""Equi-joins against a table with unique keys that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import shared

HOT_ROWS = 200_000
#: A key is hot if it also holds more than this part of an average partition's rows.
PART = 0.5


def hot_keys(counts: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Hot keys and the number of salts each needs, of ``counts (keys, _n)``; None where no key is hot.

    Hot are keys with more than ``hot_rows`` rows that also hold more than PART of an average partition, so there are at most
    partitions / PART of them, whatever the data; a key below that is no larger than what a task gets anyway.
    """
    many = counts.filter(F.col("_n") > hot_rows)
    held = many.agg(F.sum("_n")).first()[0]
    if held is None:
        return None
    spark = counts.sparkSession
    bound = max(hot_rows, int(held * PART / int(spark.conf.get("spark.sql.shuffle.partitions"))))
    salts = F.ceil(F.col("_n") / bound).cast("int").alias("_salts")
    hot = many.filter(F.col("_n") > bound).select(*keys, salts)
    found = hot.collect()  # at most partitions / PART
    return spark.createDataFrame(found, hot.schema) if found else None


def salted_lookup(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], spread_by: str, how: str = "inner", hot_rows: int = HOT_ROWS, counted: str | None = None) -> DataFrame:
    """Join ``rows`` to ``lookup``, which has at most one row per value of ``keys``.

    Rows of a hot key are spread over salts taken from the hash of ``spread_by``; the key's row in ``lookup`` is repeated
    once per salt.  Without a hot key the plan is the plain join.  Null keys never match; ``how`` is inner, left, left_semi
    or left_anti.  ``counted`` names a column of ``lookup`` with (a bound on) the number of rows of each key; without it the rows
    are counted, and ``rows`` should be a table or a cheap projection of one.  A kept table of at most ``hot_rows`` rows has no hot key.
    """
    keys = list(keys)
    known = shared.rows(rows)
    if known is not None and known <= hot_rows:
        return rows.join(lookup, keys, how)
    if counted:
        counts = lookup.select(*keys, F.col(counted).alias("_n"))
    else:
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = hot_keys(counts, keys, hot_rows)
    if hot is None:
        return rows.join(lookup, keys, how)
    salt = F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("_salts")).cast("int"), F.lit(0))
    left = rows.join(hot, keys, "left").withColumn("_salt", salt).drop("_salts")
    last = F.coalesce(F.col("_salts") - 1, F.lit(0))
    right = lookup.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def salted_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], spread_by: str, on: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of two tables that may both have many rows of a key, restricted by ``on`` while they are joined.

    A key that is hot on the left is spread over salts taken from the hash of ``spread_by`` there; the right's rows of it are repeated once per salt.
    """
    keys = list(keys)
    hot = hot_keys(left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys, hot_rows)
    if hot is None:
        return left.join(right, keys).filter(on)
    salt = F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("_salts")).cast("int"), F.lit(0))
    spread = left.join(hot, keys, "left").withColumn("_salt", salt).drop("_salts")
    last = F.coalesce(F.col("_salts") - 1, F.lit(0))
    repeated = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_salts")
    return spread.join(repeated, [*keys, "_salt"]).filter(on).drop("_salt")
