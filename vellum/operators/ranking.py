"""Global numbering without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import Scratch


def global_row_number(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``rows`` with their place (from 1) in ``order``, which has to be total for a stable result.

    Rows are range-partitioned and sorted into a written table; each partition's rows are numbered within the partition and
    shifted by the sizes of those before.  Only one count per partition is gathered.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    kept = Scratch(spark, "ranking").keep(ranged)
    sizes = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    local = kept.withColumn("_local", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    return local.join(F.broadcast(before), "_part").withColumn(name, F.col("_local") + F.col("_before")).drop("_part", "_local", "_before")
