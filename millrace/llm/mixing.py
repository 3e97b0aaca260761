"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

Targets are the level ``L * weight`` of a common water level L, clamped at ``max_epochs`` times a
source's size; L is the one level at which all targets sum to the wanted total. Redistributing the
excess of clamped sources in proportion to weights, again and again, ends at the same level.

A source is then repeated whole ``floor(target / size)`` times. The fractional repetition takes
documents in seeded order (md5 of seed and id) until the target is reached; the one document at
which it is reached is taken in part. Running sums are kept per (source, hash bin), so a source
with a third of all rows is dealt over 4096 bins.

Sizes are counted once: what the sums need of a row (source, bin, size) is saved before. There are few sources (a row each
meets in one task); documents may be any number.

Results for odd input: a null source is a source of its own, last in order; null texts have size
0; repeated rows count each; rows of a null id are ordered by a hash of all their columns; a source without words has target 0; an empty table gives an empty
result. Other columns pass through; ``source_size``, ``target``, ``repeats`` and ``part`` replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, total: Column, weights: tuple[int, ...], max_epochs: float) -> DataFrame:
    """``sizes`` (key, source_size; a row a source) with ``target``; weights repeat in key order."""
    every = Window.partitionBy()
    rows = sizes.withColumn("__place", F.row_number().over(Window.orderBy("__key")) - 1)
    rows = rows.withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__place") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("__cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("__full_at", F.col("__cap") / F.col("__w"))
    upto = Window.orderBy("__full_at", "__key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__total", total).withColumn("__caps", F.sum("__cap").over(upto) - F.col("__cap")).withColumn("__ws", F.sum("__w").over(upto) - F.col("__w")).withColumn("__all_w", F.sum("__w").over(every))
    # with all sources before this one clamped, the level of the rest; the first that stays under its cap is the water level
    rows = rows.withColumn("__level", (F.col("__total") - F.col("__caps")) / (F.col("__all_w") - F.col("__ws")))
    level = F.min(F.when(F.col("__level") <= F.col("__full_at"), F.struct("__full_at", "__key", "__level"))).over(every)
    rows = rows.withColumn("__first", level)
    clamped = F.col("__first").isNull() | (F.struct("__full_at", "__key") < F.struct(F.col("__first.__full_at"), F.col("__first.__key")))
    return rows.select("__key", "source_size", F.when(clamped, F.col("__cap")).otherwise(F.least(F.col("__first.__level") * F.col("__w"), F.col("__cap"))).alias("target"))


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), max_epochs: float = 2.0, seed: str = "mix", bins_hex: int = 3) -> DataFrame:
    """``df`` with source_size, target, repeats (whole repetitions) and part (words of the fractional one)."""
    scratch, df = Scratch(df.sparkSession, "mixing"), df.drop("source_size", "target", "repeats", "part")
    rows = df.withColumn("__key", F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source))))
    rows = rows.withColumn("__h", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.xxhash64(*df.columns).cast("string"))))).withColumn("__bin", F.substring("__h", 1, bins_hex))
    binned = scratch.save(rows.groupBy("__key", "__bin").agg(F.sum(size).alias("__n")))
    sources = binned.groupBy("__key").agg(F.sum("__n").alias("source_size"))
    goal = targets(sources, F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("repeats", whole).withColumn("__extra", F.floor(F.col("target") - F.col("repeats") * F.col("source_size") + 0.5).cast("long"))
    before = F.sum("__n").over(Window.partitionBy("__key").orderBy("__bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")
    bins = binned.withColumn("__before", before).join(goal, "__key")
    inside = Window.partitionBy("__key", "__bin").orderBy("__h", F.col(key).asc_nulls_first(), size).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("__upto", F.sum(size).over(inside)).join(bins.drop("__n"), ["__key", "__bin"])
    left = F.col("__extra") - F.col("__before") - F.col("__upto") + F.col(size)
    return placed.withColumn("part", F.greatest(F.lit(0).cast("long"), F.least(F.col(size), left))).drop("__key", "__bin", "__h", "__upto", "__before", "__extra")


def op8(docs: DataFrame) -> DataFrame:
    """How many words of each document the mix of ``documents`` takes."""
    sized = Scratch(docs.sparkSession, "mixing").save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    mixed = mix(sized)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size") + F.col("part")).alias("taken"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
                  md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY k) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
             source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM s),
f AS (SELECT *, cap / w AS full_at FROM r),
l AS (SELECT *, (total - (sum(cap) OVER u - cap)) / (sum(w) OVER () - (sum(w) OVER u - w)) AS level,
             row_number() OVER (ORDER BY full_at, k) AS n FROM f WINDOW u AS (ORDER BY full_at, k ROWS UNBOUNDED PRECEDING)),
m AS (SELECT min(n) AS n FROM l WHERE level <= full_at),
t AS (SELECT k, source_size, CASE WHEN m.n IS NULL OR l.n < m.n THEN cap ELSE least((SELECT level FROM l AS x WHERE x.n = m.n) * w, cap) END AS target FROM l, m),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
p AS (SELECT doc_id, size, source_size, target, whole, floor(target - whole * source_size + 0.5)::BIGINT
             - (sum(size) OVER (PARTITION BY d.k ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size) AS room
      FROM d JOIN g ON d.k = g.k)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, room)))::BIGINT AS taken FROM p
"""
