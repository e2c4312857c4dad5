"""The append-only log as a stream: the latest decision of each reviewer on each source, kept up to date."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.review import latest_verdicts
from ..sources.shared import shared_folder


def read_log(spark: SparkSession, pattern: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """The log's Parquet files as a stream; new files are picked up as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)


def latest_stream(log: DataFrame) -> DataFrame:
    """Same plan as the batch operator: the order is the log's ``seq``, not event time, so no watermark may drop a late row."""
    return latest_verdicts(log)


def counts_by_window(log: DataFrame, time: str = "at_time", late: str = "30 days", width: str = "7 days") -> DataFrame:
    """``(start, n)``: decisions per week with a bound on lateness; in append and update mode closed weeks leave the state.

    Times without zone are read as UTC, whatever the session's zone; weeks are counted from 1970-01-01.
    """
    zero = "timestamp_ntz'1970-01-01 00:00:00'"
    instant = F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, {zero}, cast({time} as timestamp_ntz))"))
    weeks = log.filter(F.col(time).isNotNull()).select(instant.alias("_t")).withWatermark("_t", late).groupBy(F.window("_t", width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return weeks.select(F.expr(f"{zero} + make_dt_interval(0, 0, 0, unix_micros(w.start) / 1000000)").alias("start"), "n")


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now and return its last result table."""
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"
    last: list[str] = []

    def write(batch: DataFrame, number: int) -> None:
        path = f"{root}/out-{number}"
        batch.write.parquet(path)
        last.append(path)

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(last[-1]) if last else spark.createDataFrame([], stream.schema)
