"""Queries over nested payloads (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested
from ..sources.tables import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.flat_leaves(table(spark, folder, "oa_works"))


def p4_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each flat child table and the deliveries they belong to."""
    out = None
    for name, df in nested.child_tables(table(spark, folder, "oa_works")).items():
        one = df.groupBy(F.lit(name).alias("child_table")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("delivery_id").alias("deliveries"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {"p4_found": p4_found, "p4_tables": p4_tables}

ORACLES = {
    "p4_found": """
SELECT delivery_id, 'author' AS child, i - 1 AS pos, authorships[i].author.display_name AS val
FROM (SELECT delivery_id, authorships, unnest(range(1, len(authorships) + 1)) AS i FROM oa_works) WHERE authorships[i].author.display_name IS NOT NULL
UNION ALL
SELECT delivery_id, 'reference', i - 1, referenced_works[i]
FROM (SELECT delivery_id, referenced_works, unnest(range(1, len(referenced_works) + 1)) AS i FROM oa_works) WHERE referenced_works[i] IS NOT NULL
UNION ALL
SELECT delivery_id, 'word', CAST(pos AS BIGINT), k
FROM (SELECT delivery_id, k, unnest(v) AS pos FROM (SELECT delivery_id, e.key AS k, e.value AS v FROM (SELECT delivery_id, unnest(map_entries(abstract_inverted_index)) AS e FROM oa_works)))
WHERE pos IS NOT NULL AND k IS NOT NULL
UNION ALL
SELECT delivery_id, 'landing_page', 0, primary_location.landing_page_url FROM oa_works WHERE primary_location.landing_page_url IS NOT NULL
UNION ALL
SELECT delivery_id, 'venue', 0, primary_location.source.display_name FROM oa_works WHERE primary_location.source.display_name IS NOT NULL
""",
    "p4_tables": """
SELECT 'work' AS child_table, count(*) AS rows, count(DISTINCT delivery_id) AS deliveries FROM oa_works HAVING count(*) > 0
UNION ALL
SELECT 'authorship', count(*), count(DISTINCT delivery_id) FROM (SELECT delivery_id, unnest(authorships) FROM oa_works) HAVING count(*) > 0
UNION ALL
SELECT 'reference', count(*), count(DISTINCT delivery_id) FROM (SELECT delivery_id, unnest(referenced_works) FROM oa_works) HAVING count(*) > 0
UNION ALL
SELECT 'word', count(*), count(DISTINCT delivery_id) FROM (SELECT delivery_id, unnest(e.value) AS pos FROM (SELECT delivery_id, unnest(map_entries(abstract_inverted_index)) AS e FROM oa_works)) HAVING count(*) > 0
UNION ALL
SELECT 'location', count(*), count(DISTINCT delivery_id) FROM oa_works WHERE primary_location IS NOT NULL HAVING count(*) > 0
""",
}
