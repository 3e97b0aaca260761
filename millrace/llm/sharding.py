"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Row numbers come from counts per hash bucket plus the position inside the bucket, so no task
sees more than one bucket's narrow rows and the text itself is never shuffled. The permutation
is keyed by the seed and works on pairs below ``side`` (``side`` squared covers all rows); numbers that land beyond the
last row walk on until they land inside. Position p goes to shard ``p % shards``, slot
``p // shards``: shard sizes differ by one row at most and slots have no gaps.

Results for odd input: a null ``doc_id`` is numbered like any other row; a null text counts as
empty (16 bytes, crc32 0); repeated rows get a place each; an empty table gives an empty result.
Other columns pass through; ``shard`` and ``slot`` replace columns of these names.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value of the round function: a Mersenne prime.
PRIME = 2147483647
ROUNDS, SEED = 6, 7
ROWS_PER_BUCKET, MAX_BUCKETS, WALKS = 2_000, 1 << 20, 40


def bucket_of(key: Column, buckets: int, seed: int) -> Column:
    """A bucket that depends on the key alone; arithmetic that any SQL engine repeats."""
    k = F.pmod(F.coalesce(key.cast("long"), F.lit(-1).cast("long")), F.lit(PRIME).cast("long"))
    x = F.pmod(k * 1103515245 + (12345 + seed % PRIME), F.lit(PRIME))
    return F.pmod(F.pmod(x * x + k, F.lit(PRIME)), F.lit(buckets)).cast("int")


def buckets_for(rows: int) -> int:
    return max(16, min(MAX_BUCKETS, -(-rows // ROWS_PER_BUCKET)))


def row_numbers(df: DataFrame, key: str, order: list[str], seed: int, name: str = "row_number") -> tuple[DataFrame, int]:
    """``df`` with gapless numbers from 0 in the order (bucket of ``key``, ``order``); and the number of rows."""
    total = df.count()
    b = buckets_for(total)
    keyed = df.withColumn("__bucket", bucket_of(F.col(key), b, seed))
    counts = df.select(bucket_of(F.col(key), b, seed).alias("__bucket")).groupBy("__bucket").count()
    before = counts.select("__bucket", (F.sum("count").over(Window.orderBy("__bucket")) - F.col("count")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    return keyed.withColumn("__inside", inside).join(before.hint("shuffle_hash"), "__bucket").withColumn(name, F.col("__before") + F.col("__inside") - 1).drop("__bucket", "__before", "__inside"), total


def round_keys(seed: int) -> list[tuple[int, int]]:
    """A multiplier (not 0) and an addend below PRIME for each round, from a digest of the seed."""
    words = [int.from_bytes(hashlib.sha256(f"feistel:{seed}:{i}".encode()).digest()[:8], "big") for i in range(2 * ROUNDS)]
    return [(words[2 * i] % (PRIME - 1) + 1, words[2 * i + 1] % PRIME) for i in range(ROUNDS)]


def permuted(number: Column, rows: int, seed: int = SEED) -> Column:
    """The place of a row number in a pseudo-random permutation of 0 to ``rows`` - 1, keyed by ``seed``."""
    side = math.isqrt(max(rows - 1, 0)) + 1
    keys = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(c).cast("long").alias("c")) for a, c in round_keys(seed)])

    def one_round(s: Column, k: Column) -> Column:
        x = F.pmod(F.pmod(s["r"], F.lit(PRIME)) * k["a"] + k["c"], F.lit(PRIME).cast("long"))
        y = F.pmod(x * x + k["a"], F.lit(PRIME).cast("long"))
        return F.struct(s["r"].alias("l"), F.pmod(s["l"] + y, F.lit(side).cast("long")).alias("r"))

    def feistel(x: Column) -> Column:
        low = F.pmod(x, F.lit(side).cast("long"))
        start = F.struct(((x - low) / F.lit(side)).cast("long").alias("l"), low.alias("r"))
        return F.aggregate(keys, start, one_round, lambda s: s["l"] * F.lit(side).cast("long") + s["r"])

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), feistel(number), lambda x, _: F.when(x < rows, x).otherwise(feistel(x)))
    return F.when(walk < rows, walk).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))


def shard(df: DataFrame, shards: int = 40, key: str = "doc_id", order: list[str] | None = None, seed: int = SEED) -> DataFrame:
    """``df`` with ``shard`` and ``slot``. ``order`` names narrow columns that tell rows of one key apart."""
    numbered, rows = row_numbers(df, key, [key, *(order or [])], seed, "__number")
    place = permuted(F.col("__number"), max(rows, 1), seed)
    return numbered.withColumn("__place", place).withColumn("shard", F.pmod("__place", F.lit(shards)).cast("int")).withColumn("slot", F.expr(f"`__place` div {shards}")).drop("__number", "__place")


def op2(docs: DataFrame) -> DataFrame:
    """The digest of a sharding of ``documents`` into 40 shards under the law ``rows``."""
    text = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = shard(narrow, 40, "doc_id", ["text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
