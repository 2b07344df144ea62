"""Sharding by a two-pass external shuffle.

Pass one scatters whole records over buckets by a seeded hash, so many that a bucket fits in
memory: their number follows from the bytes and rows of the table alone.  Pass two brings each
bucket into a canonical order, shuffles it (Fisher-Yates, from a generator seeded by the bucket),
deals it out and writes it: with the buckets' sizes known, a row's place in the whole order is its
bucket's offset plus its place in the bucket, and places go to the shards in turn.  Law ``rows``:
shards' counts differ by one at most, slots have no gaps.

Defined results: the order depends on the rows and the seed alone, not on partitions or settings;
null keys and null texts are values like any other; rows that are equal throughout are
interchangeable, each gets a slot, and more of them than a quarter of a bucket are scattered copy
by copy; ``keys`` must tell other rows apart; a very long text makes its bucket longer by itself;
the columns added must not be among the rows' own (names beginning with ``__`` are the operator's);
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexforge.llm.shared import partitions

BUCKET_BYTES, BUCKET_ROWS = 64 << 20, 1 << 20


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform permutation of 0..n-1; all of its draws come from one stream of this seed and bucket."""
    rng = np.random.Generator(np.random.Philox(key=[seed, bucket]))
    out = np.arange(n)
    draws = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()
    held = out.tolist()
    for i in range(n - 1, 0, -1):
        j = draws[i]
        held[i], held[j] = held[j], held[i]
    return np.array(held, np.int64)


def _hash(seed: int, keys: list[str]) -> Column:
    return F.xxhash64(F.lit(seed), *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("\0null")) for k in keys])


def _copies(rows: DataFrame, keys: list[str], size_col: str, seed: int, bucket_bytes: int, bucket_rows: int) -> DataFrame:
    """The rows with ``__copy``: 0, but for rows of which very many are equal; these are counted first, then numbered."""
    named = rows.withColumn("__key", _hash(seed, keys))
    many = named.groupBy("__key").agg(F.count("*").alias("n"), F.sum(size_col).alias("size")).filter((F.col("n") > bucket_rows // 4) | (F.col("size") > bucket_bytes // 4) & (F.col("n") > 1)).select("__key")
    if many.isEmpty():
        return named.withColumn("__copy", F.lit(0).cast("bigint"))
    hot = named.join(many, "__key", "left_semi").groupBy(*named.columns).agg(F.count("*").alias("__n"))
    hot = hot.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1))).drop("__n")
    return named.join(many, "__key", "left_anti").withColumn("__copy", F.lit(0).cast("bigint")).unionByName(hot)


def _offsets(sizes: DataFrame) -> DataFrame:
    """Each bucket's first place: running sums within runs of buckets, on top of those of the runs."""
    run = F.expr("__bucket div 4096")
    inner = Window.partitionBy(run).orderBy("__bucket")
    runs = sizes.groupBy(run.alias("__run")).agg(F.sum("count").alias("n"))  # a row for 4,096 buckets
    base = runs.select("__run", (F.sum("n").over(Window.orderBy("__run")) - F.col("n")).alias("base"))
    own = sizes.withColumn("__run", run).withColumn("own", F.sum("count").over(inner) - F.col("count"))
    return own.join(base, "__run").select(F.col("__bucket").alias("__b"), (F.col("base") + F.col("own")).alias("start"))


def two_pass(rows: DataFrame, keys: list[str], size_col: str, shards: int, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """The whole rows with ``shard`` and ``slot``, under names that they must not have yet.  ``keys`` tell rows apart and fix the order before the shuffle."""
    total = rows.agg(F.sum(size_col).alias("n"), F.count("*").alias("k")).first()
    buckets = max(1, -(-(total["n"] or 0) // bucket_bytes), -(-total["k"] // bucket_rows))
    copies = _copies(rows, keys, size_col, seed, bucket_bytes, bucket_rows)
    scattered = copies.withColumn("__bucket", F.pmod(F.xxhash64("__key", "__copy"), F.lit(buckets)).cast("bigint")).drop("__key", "__copy")
    starts = _offsets(scattered.groupBy("__bucket").count())

    def run(held: pa.Table, start: pa.Table) -> pa.Table:
        bucket, first = held.column("__bucket")[0].as_py(), start.column("start")[0].as_py()
        held = held.drop_columns(["__bucket"])
        order = pc.sort_indices(held.select(keys), [(k, "ascending") for k in keys]).to_numpy()
        held = held.take(pa.array(order[fisher_yates(held.num_rows, seed, bucket)]))
        place = first + np.arange(held.num_rows, dtype=np.int64)
        return held.append_column(shard_col, pa.array((place % shards).astype(np.int32))).append_column(slot_col, pa.array(place // shards))

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    # About a bucket a task, whatever the session's setting.
    return scattered.repartition(max(partitions(rows.sparkSession), buckets), "__bucket").groupBy("__bucket").cogroup(starts.groupBy("__b")).applyInArrow(run, f"{columns}, `{shard_col}` int, `{slot_col}` bigint")


def write_shards(sharded: DataFrame, path: str, shard_col: str = "shard", slot_col: str = "slot") -> None:
    """One folder a shard; each task writes its buckets there, rows in the order of their slots."""
    sharded.sortWithinPartitions(shard_col, slot_col).write.partitionBy(shard_col).mode("overwrite").parquet(path)
