"""Ordered file sources: text lines, JSON arrays, XML elements.

Each returns a DataFrame with ``_seq``, the position that a checkpoint stores; positions of several files follow
each other by path. Schemas are given, never inferred.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.scalars import is_blank
from millrace.model import Context
from millrace.operators.sequence import numbered

BATCH = 10_000


def number_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no from 1, line): every physical line, blank ones included.

    Splits of a large file are read in parallel; a line's number is the count of lines in the
    splits before plus its place in its own. Several files follow each other by path.
    """
    raw = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__m"))
    blocks = raw.groupBy("__f", "__b").count()
    before = blocks.select(F.col("__f").alias("__f2"), F.col("__b").alias("__b2"), (F.sum("count").over(Window.orderBy("__f", "__b")) - F.col("count")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__f", "__b").orderBy("__m"))
    rows = raw.withColumn("__i", inside).join(before, (F.col("__f") == F.col("__f2")) & (F.col("__b") == F.col("__b2")))
    return rows.select((F.col("__before") + F.col("__i")).alias("line_no"), "line")


@dataclass
class LineSource:
    """Lines of a text file through ``mapper``, a list of expressions over ``line``; no quoting.

    ``skip_header`` drops the first physical line of a fresh read. Blank lines are passed over but
    count in the position, which is the number of physical lines consumed.
    """

    spark: SparkSession
    path: str
    mapper: Callable[[Column], list[Column]] = lambda line: [line.alias("line")]
    skip_header: bool = True
    key: str = "lines.current"

    def open(self, context: Context) -> DataFrame:
        done = int(context.get(self.key, 0) or 0)
        lines = number_lines(self.spark, self.path)
        lines = lines.where(F.col("line_no") > max(done, 1 if self.skip_header and done == 0 else 0))
        return lines.where(~is_blank(F.col("line"))).select(F.col("line_no").cast("long").alias("_seq"), *self.mapper(F.col("line")))

    def save(self, context: Context, last: int) -> None:
        context.put(self.key, last)


@dataclass
class JsonArraySource:
    """Elements of a top-level JSON array; null elements are dropped. Always read from the start."""

    spark: SparkSession
    path: str
    schema: T.StructType | str

    def open(self, context: Context | None = None) -> DataFrame:
        kind = self.schema if isinstance(self.schema, str) else self.schema.simpleString()
        kind = f"array<struct<{kind}>>" if not kind.startswith("struct<") else f"array<{kind}>"
        text = self.spark.read.text(self.path, wholetext=True).select("value", F.col("_metadata.file_path").alias("__f"))
        rows = text.select("__f", F.posexplode(F.from_json("value", kind, {"mode": "FAILFAST"})).alias("__i", "__e"))
        return by_file(rows).where("__e is not null").select("_seq", "__e.*")

    def save(self, context: Context, last: int) -> None:
        """Not restartable."""


@dataclass
class XmlSource:
    """Elements of a name at any depth, in document order, nested ones of the same name included.

    ``mapper`` turns an element into a dict of ``schema``'s columns; by default child texts and
    attributes by name. ``native`` uses Spark's XML reader instead, which splits large files but
    does not give elements nested in a match and takes a column for each schema field.
    """

    spark: SparkSession
    path: str
    element: str
    schema: T.StructType | str
    mapper: Callable[[ElementTree.Element], dict] | None = None
    key: str = "xml.current"
    native: bool = False

    def open(self, context: Context) -> DataFrame:
        done = int(context.get(self.key, 0) or 0)
        kind = self.schema if isinstance(self.schema, T.StructType) else T._parse_datatype_string(self.schema)
        if self.native:
            rows = self.spark.read.format("xml").option("rowTag", self.element).schema(kind).load(self.path).withColumn("__m", F.monotonically_increasing_id())
            rows = numbered(rows, ["__m"], "__at").withColumn("_seq", F.col("__at") + 1).drop("__m", "__at")
        else:
            name, mapper, fields = self.element, self.mapper or child_texts(kind), kind.fieldNames()

            def parse(batches):
                for pdf in batches:
                    for path, data in zip(pdf["path"], pdf["content"], strict=True):
                        found: list[list] = []
                        for i, x in enumerate(elements(io.BytesIO(data), name, mapper)):
                            found.append([path, i, *(x.get(f) for f in fields)])
                            if len(found) == BATCH:
                                yield pd.DataFrame(found, columns=["__f", "__i", *fields], dtype=object)
                                found = []
                        yield pd.DataFrame(found, columns=["__f", "__i", *fields], dtype=object)

            out = T.StructType([T.StructField("__f", T.StringType()), T.StructField("__i", T.LongType()), *kind.fields])
            rows = by_file(self.spark.read.format("binaryFile").load(self.path).select("path", "content").mapInPandas(parse, out))
            rows = rows.select((F.col("_seq") + 1).alias("_seq"), *kind.fieldNames())
        return rows.where(F.col("_seq") > done)

    def save(self, context: Context, last: int) -> None:
        context.put(self.key, last)


def elements(file, name: str, mapper: Callable[[ElementTree.Element], dict]) -> Iterator[dict]:
    """Elements of a name in document order, as the parser comes by; what lies outside an element of the name is not kept."""
    open_ones, path, done = 0, [], []
    for event, e in ElementTree.iterparse(file, ("start", "end")):
        if event == "start":
            path.append(e)
            if e.tag == name:
                open_ones += 1
                done.append(e)
            continue
        path.pop()
        if e.tag == name:
            open_ones -= 1
        if open_ones == 0:
            yield from map(mapper, done)  # an element and those of its name inside it
            done = []
            e.clear()
            if path:
                path[-1].remove(e)


def by_file(rows: DataFrame) -> DataFrame:
    """``_seq`` from 0 in the order of ``__f`` (path) and ``__i`` (place in the file)."""
    sizes = rows.groupBy("__f").agg((F.max("__i") + 1).alias("__n"))  # a row for each file
    before = sizes.select(F.col("__f").alias("__f2"), (F.sum("__n").over(Window.orderBy("__f")) - F.col("__n")).alias("__before"))
    return rows.join(before, F.col("__f") == F.col("__f2")).withColumn("_seq", (F.col("__before") + F.col("__i")).cast("long")).drop("__f", "__f2", "__i", "__before")


def child_texts(kind: T.StructType) -> Callable[[ElementTree.Element], dict]:
    casts = {f.name: (int if isinstance(f.dataType, T.IntegralType) else float if isinstance(f.dataType, T.FractionalType) else str) for f in kind.fields}

    def read(e: ElementTree.Element) -> dict:
        raw = {n: e.findtext(n, e.get(n)) for n in casts}
        return {n: None if raw[n] is None else c(raw[n]) for n, c in casts.items()}

    return read
