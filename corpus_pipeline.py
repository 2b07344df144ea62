"""A corpus pipeline: quality rules, near duplicates, decontamination, secrets, tokens.

Each stage takes all that the one before kept and returns the columns of ``documents``; the last
returns token digests.  Null texts fail the quality rules; repeated rows are copies, of which one
stays; rows that share an id but not a text are told apart; empty tables give empty tables; further
columns come along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import decontaminate, near, quality, queries_tokens, secrets
from lexforge.llm.shared import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the line field and the base rules keep."""
    weights = quality.fit(*quality.training_sample(docs, table(spark, sf_dir, "labels")))
    # Under names of their own: the counts' names may clash with further columns.
    columns = [f"d{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*columns)
    judged = quality.judge(inner, weights, text_col=columns[docs.columns.index("text")], carry=tuple(columns))
    return judged.filter("kept").select(*columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of similar documents, the first by id and text; rows without an id are judged like others.

    Ids may repeat, so rows go through the join under a 64-bit number of id and text; equal rows share it.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    key, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    numbered = docs.toDF(*names).withColumn("row", F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("\0")), F.coalesce(text, F.lit("\0"))))
    groups = near.jaccard_join(numbered.select("row", text), "row", text).select("row", "class_id").distinct()
    order = F.struct(F.col(key).isNull(), key, near.text_key(text))
    first = numbered.select("row", order.alias("key")).join(groups, "row").groupBy("class_id").agg(F.min_by("row", "key").alias("row"))
    return numbered.join(first, "row", "left_semi").dropDuplicates(["row"]).select(*names).toDF(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which no benchmark item is found."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents; confirmed secrets are masked and ``n_chars`` follows."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded bytes."""
    return queries_tokens.digest(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontaminated),
    ("secret_scan", secrets_masked),
    ("byte_bpe", encoded),
]

#: The line field, the edit windows and the merges are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
