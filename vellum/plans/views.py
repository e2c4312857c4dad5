"""The ledger of a review over the given tables: tables as they are where they fit, the rest derived by rule.

``sources``, ``screening`` and ``queries`` are used as they are.  Evidence is taken once per id.  Claims, verifications,
contradictions and extraction cells have no table of their own; they are derived from the evidence numbers by the same
expressions here and in SQL, with some orphans and gaps so that every rule has something to find.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import vocab
from ..operators import review
from ..sources.shared import Scratch
from ..sources.tables import table


class Ledger:
    """The tables and derived views of one data folder, each built on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return table(self.spark, self.folder, name)

    @cached_property
    def latest(self) -> DataFrame:
        return review.latest_verdicts(self.screening)

    @cached_property
    def included(self) -> DataFrame:
        return review.included_sources(self.sources, self.latest).select("id")

    @cached_property
    def ev(self) -> DataFrame:
        first = W.partitionBy("id").orderBy(F.asc_nulls_first("at_time"), F.asc_nulls_first("summary"))
        rows = self.evidence.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")
        return rows.withColumn("num", F.substring("id", 2, 12).cast("bigint"))

    @cached_property
    def claims(self) -> DataFrame:
        k = F.col("k")
        by = self.ev.groupBy(F.floor(F.col("num") / 6).cast("bigint").alias("k")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
        ids = F.when(k % 23 == 0, F.array().cast("array<string>")).when(k % 17 == 0, F.concat("ids", F.array(F.lit("E999999999")))).otherwise(F.col("ids"))
        consensus = F.element_at(F.array(*map(F.lit, vocab.CONSENSUS)), (k % 5 + 1).cast("int"))
        return by.select("k", F.concat(F.lit("CL"), F.lpad(k.cast("string"), 9, "0")).alias("id"), ids.alias("evidence"), consensus.alias("consensus"))

    @cached_property
    def cited(self) -> DataFrame:
        """Claims with each piece of evidence they cite that exists: ``(claim, consensus, eid, score, source)``."""
        ids = self.claims.select(F.col("id").alias("claim"), "consensus", F.explode("evidence").alias("eid"))
        return ids.join(self.ev.select(F.col("id").alias("eid"), "score", "source"), "eid")

    @cached_property
    def verification(self) -> DataFrame:
        k = F.col("k")
        status = F.when(k % 7 == 0, "unsupported").when(k % 7 == 1, "contradicted").when(k % 7 == 2, "partial").otherwise("supported")
        return self.claims.filter(k % 4 != 3).select(
            F.concat(F.lit("V"), F.lpad(k.cast("string"), 9, "0")).alias("id"),
            F.when(k % 29 == 0, F.concat("id", F.lit("9"))).otherwise(F.col("id")).alias("claim"),
            status.alias("status"), F.slice("evidence", 1, 2).alias("evidence"),
        )

    @cached_property
    def contradictions(self) -> DataFrame:
        kind = F.element_at(F.array(*map(F.lit, vocab.CONTRADICTION_CLASSES)), (F.floor(F.col("k") / 5) % 5 + 1).cast("int"))
        rows = self.claims.filter((F.col("k") % 5 == 0) & (F.size("evidence") >= 2))
        return rows.select(F.col("evidence")[0].alias("a"), F.when(F.col("k") % 35 == 0, "E888888888").otherwise(F.col("evidence")[1]).alias("b"), kind.alias("class"))

    @cached_property
    def extraction(self) -> DataFrame:
        n = F.col("num")
        value = F.when(n % 13 == 0, "not reported").when(n % 17 == 0, F.concat(F.lit("inferred: "), F.substring("summary", 1, 20))).otherwise(F.substring("summary", 1, 40))
        return self.ev.filter("source is not null and question is not null").select("source", F.col("question").alias("column"), value.alias("value"), "quote", "locator", n.alias("seq"))


class KeptLedger(Ledger):
    """A ledger for many queries at once: the views that most rules share are written to the shared folder when they are first used."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder)
        self._scratch = Scratch(spark, "ledger")

    @cached_property
    def latest(self) -> DataFrame:
        return self._scratch.keep(Ledger.latest.func(self))

    @cached_property
    def included(self) -> DataFrame:
        return self._scratch.keep(Ledger.included.func(self))

    @cached_property
    def ev(self) -> DataFrame:
        return self._scratch.keep(Ledger.ev.func(self))

    @cached_property
    def claims(self) -> DataFrame:
        return self._scratch.keep(Ledger.claims.func(self))

    @cached_property
    def cited(self) -> DataFrame:
        return self._scratch.keep(Ledger.cited.func(self))


#: The same views in SQL.
SQL = r"""
WITH lv AS (
  SELECT source, reviewer, lower(regexp_replace(verdict, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS verdict, reason, stage, seq
  FROM screening WHERE source IS NOT NULL AND reviewer IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY source, reviewer ORDER BY seq DESC NULLS LAST) = 1
), p1 AS (SELECT * FROM lv WHERE reviewer = 'pass1'), p2 AS (SELECT * FROM lv WHERE reviewer = 'pass2'),
inc AS (SELECT id FROM sources WHERE id IN (SELECT source FROM p1 WHERE verdict = 'include')),
ev AS (
  SELECT *, CAST(substr(id, 2, 12) AS BIGINT) AS num FROM evidence
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY at_time NULLS FIRST, summary NULLS FIRST) = 1
), cg AS (SELECT num // 6 AS k, list_sort(list(id)) AS ids FROM ev GROUP BY 1
), claims AS (
  SELECT k, 'CL' || lpad(CAST(k AS VARCHAR), 9, '0') AS id,
    CASE WHEN k % 23 = 0 THEN CAST([] AS VARCHAR[]) WHEN k % 17 = 0 THEN list_append(ids, 'E999999999') ELSE ids END AS evidence,
    (['strong', 'moderate', 'contested', 'thin', 'absent'])[k % 5 + 1] AS consensus FROM cg
), verification AS (
  SELECT 'V' || lpad(CAST(k AS VARCHAR), 9, '0') AS id, CASE WHEN k % 29 = 0 THEN id || '9' ELSE id END AS claim,
    CASE k % 7 WHEN 0 THEN 'unsupported' WHEN 1 THEN 'contradicted' WHEN 2 THEN 'partial' ELSE 'supported' END AS status,
    evidence[1:2] AS evidence FROM claims WHERE k % 4 <> 3
), contradictions AS (
  SELECT evidence[1] AS a, CASE WHEN k % 35 = 0 THEN 'E888888888' ELSE evidence[2] END AS b,
    (['direct', 'scope', 'methodological', 'version-drift', 'interpretive'])[(k // 5) % 5 + 1] AS class
  FROM claims WHERE k % 5 = 0 AND len(evidence) >= 2
), extraction AS (
  SELECT source, question AS "column", CASE WHEN num % 13 = 0 THEN 'not reported' WHEN num % 17 = 0 THEN 'inferred: ' || substr(summary, 1, 20) ELSE substr(summary, 1, 40) END AS value, quote, locator, num AS seq
  FROM ev WHERE source IS NOT NULL AND question IS NOT NULL
), ce AS (SELECT id AS claim, consensus, k, unnest(evidence) AS eid FROM claims),
cs AS (SELECT ce.claim, ce.consensus, ev.id AS eid, ev.score, ev.source FROM ce JOIN ev ON ev.id = ce.eid)
"""
