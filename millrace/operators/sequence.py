"""Positions and chunks in a stated order, without sending all rows through one task.

A table is cut into ranges of its first ordering column, rows are counted per range, and a row's
position is the count of all ranges before plus its place in its own. Only the counts (a row per
range) meet in one task.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

ROWS_PER_RANGE, MAX_RANGES, LITERAL_RANGES, UNEVEN = 50_000, 1 << 16, 1024, 8


def _ranges(df: DataFrame, order: list[str]) -> tuple[DataFrame, dict[int, int] | None]:
    """``df`` with ``__range``, growing with ``order``; and the rows of each range, if they are known.

    Integer keys are cut into equal ranges, which needs no shuffle of its own. Where these hold very
    uneven numbers of rows (few distinct keys, far outliers), or for other keys, rows are dealt by
    sampled bounds of all ordering columns, which also splits a frequent first key; that result is
    kept on disk, so that counts and positions see the same ranges (``spark.catalog.clearCache()``
    frees it).
    """
    if isinstance(df.schema[order[0]].dataType, T.IntegralType):
        first = F.col(order[0]).cast("long")
        low, high, n = df.agg(F.min(first), F.max(first), F.count("*")).first()
        if low is None:
            low = high = 0
        parts = max(1, min(MAX_RANGES, n // ROWS_PER_RANGE))
        width = (high - low) // parts + 1
        # nulls come first, as in an ascending sort
        even = df.withColumn("__range", F.coalesce(F.expr(f"(cast(`{order[0]}` as decimal(38,0)) - {low}) div {width}").cast("long"), F.lit(0).cast("long")))
        if parts == 1:
            return even, {0: n}
        counts = dict(even.groupBy("__range").count().collect())  # at most MAX_RANGES rows
        if max(counts.values()) <= UNEVEN * n / parts:
            return even, counts
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = df.repartitionByRange(parts, *[F.col(c).asc_nulls_first() for c in order])
    return spread.withColumn("__range", F.spark_partition_id().cast("long")).persist(StorageLevel.DISK_ONLY), None


def numbered(df: DataFrame, order: list[str], name: str = "_seq") -> DataFrame:
    """``df`` with positions from 0 in the order of the columns ``order``."""
    rows, counts = _ranges(df, order)
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    rows = rows.withColumn("__inside", inside)
    if counts is not None and max(counts, default=0) < LITERAL_RANGES:
        before = [0, *accumulate(counts.get(i, 0) for i in range(max(counts, default=0)))]
        rows = rows.withColumn("__before", F.expr(f"element_at(array({', '.join(f'{n}L' for n in before)}), cast(__range as int) + 1)"))
    else:
        sizes = df.sparkSession.createDataFrame(sorted(counts.items()), "__range long, count long") if counts is not None else rows.groupBy("__range").count()
        rows = rows.join(sizes.select("__range", (F.sum("count").over(Window.orderBy("__range")) - F.col("count")).alias("__before")), "__range")
    return rows.withColumn(name, (F.col("__before") + F.col("__inside") - 1).cast("long")).drop("__range", "__before", "__inside")


def chunk_of(position: Column, size: int) -> Column:
    """The chunk of a position from 0."""
    return F.floor(position / size).cast("long")


def chunked(df: DataFrame, order: list[str], size: int = 10, name: str = "_chunk") -> DataFrame:
    """``df`` with the number of each row's chunk: ``size`` rows each, the last may be short."""
    if size < 1:
        raise ValueError("a chunk has one row at least")
    return numbered(df, order, "__at").withColumn(name, chunk_of(F.col("__at"), size)).drop("__at")


def chunk_sizes(df: DataFrame, size: int) -> DataFrame:
    """(chunk, n) of the chunks that a table of these rows makes, from its row count alone."""
    total = df.agg(F.count("*").alias("total"))
    chunks = total.where("total > 0").select("total", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(total - 1) div {size}"))).alias("chunk"))
    return chunks.select("chunk", F.least(F.lit(size).cast("long"), F.col("total") - F.col("chunk") * size).alias("n"))


def size_histogram(df: DataFrame, size: int) -> DataFrame:
    """(n, chunks): how many chunks have n rows, whichever rows they hold."""
    full = df.agg(F.count("*").alias("total")).select(F.explode(F.array(F.struct(F.lit(size).cast("long").alias("n"), F.expr(f"total div {size}").alias("chunks")), F.struct((F.col("total") % size).alias("n"), F.lit(1).cast("long").alias("chunks")))).alias("x"))
    return full.select("x.*").where("n > 0 and chunks > 0")


def after(df: DataFrame, key: str, last: object) -> DataFrame:
    """Rows beyond a checkpoint; no checkpoint means all rows."""
    return df if last is None else df.where(F.col(key) > F.lit(last))
