"""Chunk steps over unbounded input: each micro-batch is a group of chunks.

Structured Streaming keeps the position in its checkpoint folder and hands a failed batch out again
under the same number, so sinks that replace their group by number (the folder sinks) hold every row once; others
append it again. A chunk's number holds its batch's in the upper 32 bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.processing import Processor
from millrace.operators.sequence import chunked
from millrace.sinks.files import Sink


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def run_stream(rows: DataFrame, processor: Processor, sink: Sink, checkpoint: str, order: list[str], chunk_size: int = 1000, name: str = "stream", available_now: bool = True, after: Callable[[int, int], None] | None = None) -> StreamingQuery:
    """Starts the query; ``order`` numbers the rows inside a batch, ``after`` gets (batch, rows)."""

    def commit(batch: DataFrame, number: int) -> None:
        out = processor.apply(batch)
        numbered = chunked(out, order, chunk_size).withColumn("_seq", _position(order))
        numbered = numbered.withColumn("_chunk", F.col("_chunk") + (number << 32))  # no batch repeats another's chunk numbers
        numbered = numbered.persist()
        try:
            n = numbered.count()
            if n:
                sink.write(numbered, name, number)
            if after is not None:
                after(number, n)
        finally:
            numbered.unpersist()

    writer = rows.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _position(order: list[str]) -> Column:
    return F.col(order[0]).cast("long")
