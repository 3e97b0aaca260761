"""Keyset and offset scans of relational sources.

The resume predicate is part of the query, so it reaches the scan (Parquet row groups, a JDBC
``WHERE``); nothing is paged by hand.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.model import Context
from millrace.operators.sequence import numbered


@dataclass
class KeysetSource:
    """Rows of ``table`` by a unique, ordered integer key, beyond the last key of the checkpoint."""

    table: DataFrame
    key_column: str
    key: str = "keyset.last"

    def open(self, context: Context) -> DataFrame:
        last = context.get(self.key)
        rows = self.table if last is None else self.table.where(F.col(self.key_column) > F.lit(last))
        return rows.where(F.col(self.key_column).isNotNull()).withColumn("_seq", F.col(self.key_column).cast("long"))

    def save(self, context: Context, last: int) -> None:
        context.put(self.key, last)


def strictly_rising(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """What a keyset scan yields of rows in ``order`` whose keys repeat or fall: those above all before."""
    if order[0] == key:  # sorted by the key: the first row of each key
        w = Window.partitionBy(key).orderBy(*order)
        return df.where(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    rows = numbered(df, order, "__at")
    # maxima of blocks of positions first, then inside each block
    rows = rows.withColumn("__block", F.expr("__at div 50000"))
    tops = rows.groupBy("__block").agg(F.max(key).alias("__top"))
    before = tops.select("__block", F.max("__top").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    inside = F.max(key).over(Window.partitionBy("__block").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__inside", inside).join(before, "__block")
    high = F.greatest("__inside", "__before")
    return rows.where(F.col(key).isNotNull() & (high.isNull() | (F.col(key) > high))).drop("__at", "__block", "__inside", "__before")


@dataclass
class OffsetSource:
    """Rows of ``table`` in ``order``, from the checkpoint's offset on."""

    table: DataFrame
    order: list[str]
    key: str = "offset.next"

    def open(self, context: Context) -> DataFrame:
        done = int(context.get(self.key, 0) or 0)
        return numbered(self.table, self.order, "__at").where(F.col("__at") >= done).withColumn("_seq", F.col("__at") + 1).drop("__at")

    def save(self, context: Context, last: int) -> None:
        context.put(self.key, last)


def page(df: DataFrame, order: list[str], offset: int, size: int) -> DataFrame:
    """One page of a sorted table."""
    return df.orderBy(*order).offset(offset).limit(size)


def bound_query(spark: SparkSession, sql: str, parameters: dict[str, object] | None = None, offset: int = 0, page_size: int = 1000) -> DataFrame:
    """A page of a query with named markers; ``:offset`` and ``:page_size`` win over the caller's."""
    return spark.sql(sql, args={**(parameters or {}), "offset": offset, "page_size": page_size})


@dataclass
class JdbcSource:
    """A JDBC table read in ranges of an integer key, resumed by keyset; needs the driver's jar."""

    spark: SparkSession
    url: str
    table: str
    key_column: str
    bounds: tuple[int, int]
    parts: int = 8
    options: dict[str, str] = field(default_factory=dict)
    key: str = "keyset.last"

    def open(self, context: Context) -> DataFrame:
        last = context.get(self.key)
        rows = self.spark.read.jdbc(self.url, self.table, column=self.key_column, lowerBound=self.bounds[0], upperBound=self.bounds[1] + 1, numPartitions=self.parts, properties=self.options)
        rows = rows if last is None else rows.where(F.col(self.key_column) > F.lit(last))
        return rows.withColumn("_seq", F.col(self.key_column).cast("long"))

    def save(self, context: Context, last: int) -> None:
        context.put(self.key, last)


def range_read(table: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """The rows of one partition's inclusive range."""
    return table.where(F.col(key).between(low, high)).withColumn("_seq", F.col(key).cast("long"))
