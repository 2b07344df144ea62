"""Streaming forms of the history scan and the usage totals: extensions, not parity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_history(commits: DataFrame, path: str, author: str, at: str) -> DataFrame:
    """Commits, authors and first and last times of each path, kept up as rows arrive (complete or update mode); the state holds a path's authors, as the batch form counts them."""
    return commits.groupBy(path).agg(F.count("*").alias("commits"), F.size(F.collect_set(author)).alias("authors"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def usage_windows(usage: DataFrame, at: str, keys: list[str], sums: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Totals of each window and key; a window closes when the watermark passes it (append mode)."""
    return usage.withWatermark(at, late).groupBy(F.window(at, width).alias("span"), *keys).agg(F.count("*").alias("calls"), *[F.sum(s).alias(s) for s in sums]).select(F.col("span.start").alias("start"), *keys, "calls", *sums)


def upsert(batch: DataFrame, batch_id: int, store: str, keys: list[str], order: str) -> None:
    """foreachBatch body: the newest record of each key into a folder of this batch; a batch that is replayed replaces its own folder, so nothing is written twice.  Readers take the latest of each key."""
    from lexforge.operators.ranking import latest

    latest(batch, keys, [F.desc(order)]).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
