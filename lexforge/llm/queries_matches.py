"""Queries that match documents with one another, with templates or with benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexforge.llm import decontaminate, licenses, near, secrets
from lexforge.llm.shared import table


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.jaccard_join(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))
