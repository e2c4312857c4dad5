"""Tables written to the shared folder, to cut lineage and to survive the loss of executors.

``checkpoint()`` and ``materialize()`` both write to the folder the cluster names in
``spark.checkpoint.dir``.  ``materialize`` writes Parquet, so that what is read back is columnar,
compressed and of known size, which lets the optimizer choose broadcasts by fact.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where the master is local and none is set."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(folder)
        return folder
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="vellum-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(f"file://{folder}")
    return f"file://{folder}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Folders of this process's operators that still stand.
_ROOTS: dict[str, SparkSession] = {}


def clear() -> None:
    """Remove the tables of all operators run so far.  What they returned can't be read any more, so write or collect it first."""
    for root, spark in list(_ROOTS.items()):
        _ROOTS.pop(root, None)
        try:
            remove(spark, root)
        except Exception:  # the session is gone; the folder's own retention applies
            pass


atexit.register(clear)


class Scratch:
    """The tables of one run of an operator.

    Superseded ones are removed as an iteration goes on.  The rest stand as long as the returned rows may be read: until ``clear()``
    is called, as between the queries of a long session, or Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        _ROOTS[self.root] = spark

    def keep(self, df: DataFrame, **measures: Column) -> DataFrame:
        """Write ``df`` now and return the table read back.

        Its number of rows, and the aggregates named in ``measures``, are observed while it is written; see ``rows`` and ``measure``.
        """
        self.n += 1
        path = f"{self.root}/{self.n:04d}"
        seen, sums = Observation(), [F.count(F.lit(1)).alias("_rows"), *[m.alias(k) for k, m in measures.items()]]
        df.observe(seen, *sums).write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        told = seen.get
        if "_rows" not in told:  # a plan that was optimized away reports nothing
            told = back.agg(*sums).first().asDict()
        back._vellum_path, back._vellum_seen = path, told
        return back

    def drop(self, *frames: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        for df in frames:
            if path := getattr(df, "_vellum_path", None):
                remove(self.spark, path)


def rows(df: DataFrame) -> int | None:
    """The number of rows of a kept table; None for other frames."""
    return getattr(df, "_vellum_seen", {}).get("_rows")


def measure(df: DataFrame, name: str):
    """An aggregate observed while ``df`` was written."""
    return df._vellum_seen.get(name)
