"""A training corpus from ``documents``: language, near duplicates, benchmarks, mixture, shards.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; every result is
written as Parquet and read back, so a lost executor costs part of one stage. A stage renames the columns
it does not work on and names them back at its end, so any others pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import contamination, langid, mixing, ngram_join, sharding
from millrace.llm.scratch import Scratch

SHARDS = 40


def aside(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with all columns but those of ``used`` renamed, and the columns that name them back."""
    names = {c: c if c in used else f"__c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), [F.col(new).alias(old) for old, new in names.items()]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language can be told.

    These are null and empty texts and texts without a letter, of any length. Where no text has a label the others stay. Nulls in other columns
    and ids do not matter; ties between languages do not matter; repeated rows all stay or all go; an empty table gives an empty result.
    """
    rows, back = aside(docs, "text")
    told = langid.predict(rows, langid.fit(docs))
    return told.where("lang_pred is null or lang_pred <> 'und'").select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of Jaccard links: the one of the smallest id.

    Rows are told apart by a hash of all their columns, so a repeated or null id hides no copy: of repeated rows one stays, of rows that share an id
    the one of the smallest hash, and a null id only where its component has no other. Null and wordless texts are
    linked with nothing and stay, very long ones count whole; an empty table gives an empty result.
    """
    rows, back = aside(docs, "doc_id", "text")
    keyed = rows.withColumn("__key", F.xxhash64(*rows.columns))
    scratch = Scratch(spark, "near-duplicates")
    ids = scratch.save(keyed.groupBy("__key").agg(F.min("doc_id").alias("__id")))
    classes = ngram_join.classes(keyed.select(F.col("__key").alias("doc_id"), "text")).select(F.col("doc_id").alias("__key"), "component_id").distinct()
    best = classes.join(ids, "__key").groupBy("component_id").agg(F.min(F.struct(F.col("__id").isNull(), "__id", "__key")).alias("best"))
    kept = scratch.save(best.select(F.col("best.__key").alias("__key")))
    return keyed.join(kept, "__key").dropDuplicates(["__key"]).select(*back)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark windows cover a twentieth or more.

    Null and empty texts have no words and stay, as do all where the benchmark is empty; very long texts count whole; repeated rows all stay or all
    go; ids and other columns do not matter; an empty table gives an empty result.
    """
    rows, back = aside(docs, "text")
    found = contamination.find(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return contamination.judged(found).where("not contaminated").select(*back)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources come near their target sizes.

    The one document that a source's fractional repetition takes in part is taken whole if half of it or more is wanted. A null source is one of its own;
    null and empty texts have size 0 and stay as often as their source is repeated whole, but once at least; repeated rows count each; null ids are ordered by their
    other columns; a very long text is one row like others; an empty table gives an empty result.
    """
    rows, back = aside(docs, "doc_id", "source", "text")
    mixed = mixing.mix(rows.withColumn("__size", mixing.word_count(F.col("text"))), size="__size")
    more = F.when((F.col("part") > 0) & (F.col("part") * 2 >= F.col("__size")), 1).otherwise(0)
    times = F.when(F.col("__size") == 0, F.greatest("repeats", F.lit(1))).otherwise(F.col("repeats") + more)
    return mixed.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), times.cast("int")))).select(*back)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the rows into 40 shards in a reproducible random order; adds ``shard`` and ``slot``.

    Null ids, null, empty and very long texts are rows like others; rows of one id are ordered by a hash of their columns and
    repeated rows get a place each; columns ``shard`` and ``slot`` are replaced; an empty table gives an empty result.
    """
    rows, back = aside(docs.drop("shard", "slot"), "doc_id")
    return sharding.shard(rows.withColumn("__hash", F.xxhash64(*rows.columns)), SHARDS, "doc_id", ["__hash"]).select(*back, "shard", "slot")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("shards", shards)]

#: The first stage rests on a trained model, so SQL cannot express the pipeline; tests/llm compares it with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table goes as soon as the next one is written."""
    scratch = Scratch(spark, "pipeline")
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
        if last is not None:
            scratch.drop(last)
        last = docs
    return docs
