"""Result pages of a catalogue, one row per record: ``read_pages`` from any file system, and a Python data source over a local folder, one input partition per page.

``spark.dataSource.register(CataloguePages)``, then ``spark.read.format("catalogue_pages").option("path", folder).load()``.
A page is a JSON file holding an array, or an object with ``results``, ``records`` or ``sources``; a page that can't be
read gives no rows, as a failed request would.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``(page, place, id, title, record)`` of the same pages from any file system that Spark reads, without Python workers.

    A page that can't be parsed gives no rows; elements that are no objects are left out but keep their place.
    """
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("page"), F.expr("try_parse_json(value)").alias("v"))
    lists = [F.try_variant_get("v", at, "array<variant>") for at in ("$", "$.results", "$.records", "$.sources")]
    rows = files.select("page", F.posexplode(F.coalesce(*lists)).alias("place", "r")).filter(F.schema_of_variant("r").startswith("OBJECT"))
    text = lambda at: F.coalesce(F.try_variant_get("r", at, "string"), F.lit(""))
    title = F.when(text("$.title") == "", text("$.display_name")).otherwise(text("$.title"))
    return rows.select("page", "place", text("$.id").alias("id"), title.alias("title"), F.to_json("r").alias("record"))


class Page(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PageReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Page]:
        return [Page(str(p)) for p in sorted(Path(self.folder).glob("*.json"))]

    def read(self, page: Page) -> Iterator[tuple]:
        try:
            got = json.loads(Path(page.path).read_text(encoding="utf-8"))
        except (OSError, ValueError):
            return
        if isinstance(got, dict):
            got = next((got[k] for k in ("results", "records", "sources") if isinstance(got.get(k), list)), [])
        for place, record in enumerate(got):
            if isinstance(record, dict):
                yield Path(page.path).name, place, str(record.get("id") or ""), str(record.get("title") or record.get("display_name") or ""), json.dumps(record, ensure_ascii=False, sort_keys=True)


class CataloguePages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catalogue_pages"

    def schema(self) -> str:
        return "page string, place int, id string, title string, record string"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options["path"])
