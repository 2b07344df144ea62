"""Queries that judge, name and deal out single documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import langid, quality, sharding, warc
from lexforge.llm.shared import shared_path, table


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = quality.fit(*quality.training_sample(docs, table(spark, sf_dir, "labels")))
    return quality.judge(docs, weights)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    net = langid.train(*langid.training_sample(docs, ~held_out))
    return langid.predict(docs, net).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards, whole documents with their texts, and returns the digest of what was written."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    path = shared_path(spark, "shards")
    sharding.write_shards(sharding.two_pass(rows, ["doc_id", "text_crc32", "size"], "size", shards=24), path)
    written = spark.read.parquet(path)
    return written.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
