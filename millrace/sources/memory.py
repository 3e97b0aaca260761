"""Rows of the driver, and any DataFrame with an order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.model import Context
from millrace.operators.sequence import numbered


class MemorySource:
    """A list of tuples under a schema; positions from 1. With ``key`` it resumes after a checkpoint."""

    def __init__(self, spark: SparkSession, rows: Iterable[tuple], schema: str, key: str | None = None):
        self.spark, self.rows, self.schema, self.key = spark, list(rows), schema, key

    def open(self, context: Context | None = None) -> DataFrame:
        done = int(context.get(self.key, 0) or 0) if context is not None and self.key else 0
        rows = [(i + 1, *r) for i, r in enumerate(self.rows)][done:]
        return self.spark.createDataFrame(rows, f"_seq long, {self.schema}")

    def save(self, context: Context, last: int) -> None:
        if self.key:
            context.put(self.key, last)


class FrameSource:
    """A DataFrame in a stated order."""

    def __init__(self, df: DataFrame, order: list[str], key: str = "frame.last"):
        self.df, self.order, self.key = df, order, key

    def open(self, context: Context) -> DataFrame:
        done = int(context.get(self.key, 0) or 0)
        return numbered(self.df, self.order, "__at").withColumn("_seq", F.col("__at") + 1).drop("__at").where(F.col("_seq") > done)

    def save(self, context: Context, last: int) -> None:
        context.put(self.key, last)
