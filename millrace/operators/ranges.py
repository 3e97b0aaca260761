"""Range partitioning of integer keys, and the status of a partitioned step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.model import Context


@dataclass(frozen=True)
class RangePartitioner:
    """Cuts the inclusive range into equal parts, the last with the remainder. With more parts than
    keys all but the last are empty (their maximum is below their minimum)."""

    low: int
    high: int

    def __post_init__(self) -> None:
        if self.low > self.high:
            raise ValueError("the range is empty")

    def bounds(self, grid: int) -> list[tuple[str, int, int]]:
        if grid < 1:
            raise ValueError("a grid has one part at least")
        base, rest = divmod(self.high - self.low + 1, grid)
        starts = [self.low + i * base for i in range(grid)]
        return [(f"partition{i}", s, s + base - 1 + (rest if i == grid - 1 else 0)) for i, s in enumerate(starts)]

    def partition(self, grid: int) -> dict[str, Context]:
        out = {}
        for name, low, high in self.bounds(grid):
            out[name] = Context()
            out[name].put("partition.minValue", low)
            out[name].put("partition.maxValue", high)
        return out

    def number_of(self, key: Column, grid: int) -> Column:
        """The part that a key of the range belongs to."""
        base = (self.high - self.low + 1) // grid
        if base == 0:
            return F.lit(grid - 1)
        return F.least(F.floor((key.cast("long") - self.low) / base), F.lit(grid - 1)).cast("int")


def bounds_frame(spark: SparkSession, partitioner: RangePartitioner, grid: int) -> DataFrame:
    return spark.createDataFrame(partitioner.bounds(grid), "`partition` string, min_value long, max_value long")


def range_of(df: DataFrame, key: str) -> RangePartitioner:
    low, high = df.agg(F.min(key), F.max(key)).first()
    return RangePartitioner(low, high)


def folded_status(failed: Column, stopped: Column) -> Column:
    """Failed if any part failed, else stopped if any stopped, else completed."""
    return F.when(F.coalesce(F.max(failed), F.lit(False)), "Failed").when(F.coalesce(F.max(stopped), F.lit(False)), "Stopped").otherwise("Completed")
