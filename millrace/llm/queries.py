"""The registered queries of this subpackage and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import contamination, katz, langid, media, mixing, ngram_join, pii, secret_scan, sharding, substring


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.op1(table(spark, sf_dir, "documents"))


def op2_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op2(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.op3(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.op4(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.op5(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op6(table(spark, sf_dir, "documents"))


def op7_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.op7(table(spark, sf_dir, "embeddings"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op8(table(spark, sf_dir, "documents"))


def op9_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.op9(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op10(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_feistel_sharding, op3_substring_dedup, op4_secret_scan, op5_benchmark_decontamination, op6_pii_bootstrap, op7_image_copies, op8_source_mixing, op9_katz_scores, op10_language_id)}
#: The others have no SQL: crc32, trained models and scores; tests compare them with plain versions.
SQL = {"op1_ngram_jaccard_join": ngram_join.OP1_SQL, "op3_substring_dedup": substring.OP3_SQL, "op5_benchmark_decontamination": contamination.OP5_SQL, "op8_source_mixing": mixing.OP8_SQL}
