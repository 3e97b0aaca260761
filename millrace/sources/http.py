"""Paginated HTTP: pages 1, 2, ... of JSON rows until one is empty, as a Python data source."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import LongType, StructField, StructType, _parse_datatype_string

from millrace.model import Context


def page_url(base: str, page: int) -> str:
    return f"{base}{'&' if '?' in base else '?'}page={page}"


class PageReader(DataSourceReader):
    """One partition: how many pages there are is not known before they are read."""

    def __init__(self, options: dict[str, str], fields: list[str]):
        self.base, self.timeout, self.fields = options["url"], float(options.get("timeout", "30")), fields

    def read(self, partition) -> Iterator[tuple]:  # noqa: ARG002
        seq, page = 0, 1
        while True:
            with urllib.request.urlopen(page_url(self.base, page), timeout=self.timeout) as answer:  # raises on errors
                rows = json.load(answer)
            if not rows:
                return
            for row in rows:
                seq += 1
                yield (seq, *(row.get(f) for f in self.fields[1:]))
            page += 1


class PagedHttp(DataSource):
    """``spark.read.format("paged_http").schema(...).option("url", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "paged_http"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader(dict(self.options), schema.fieldNames())


class HttpSource:
    """Rows of all pages with ``_seq``; not restartable. ``parse`` may change the frame."""

    def __init__(self, spark: SparkSession, url: str, schema: str, parse: Callable[[DataFrame], DataFrame] | None = None, timeout: float = 30.0):
        self.spark, self.url, self.schema, self.parse, self.timeout = spark, url, schema, parse, timeout

    def open(self, context: Context | None = None) -> DataFrame:
        self.spark.dataSource.register(PagedHttp)
        kind = StructType([StructField("_seq", LongType()), *_parse_datatype_string(self.schema).fields])
        rows = self.spark.read.format("paged_http").schema(kind).option("url", self.url).option("timeout", str(self.timeout)).load()
        return rows if self.parse is None else self.parse(rows)

    def save(self, context: Context, last: int) -> None:
        """Not restartable."""
