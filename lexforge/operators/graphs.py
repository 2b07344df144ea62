"""Bounded graph steps and constrained merging."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def kept(df: DataFrame) -> DataFrame:
    """The rows in the session's shared checkpoint folder; one of our own only in local mode, where driver and executors are one machine."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexforge-"))
    return df.checkpoint()


def bounded_slice(edges: DataFrame, starts: DataFrame, depth: int, most: int | None) -> DataFrame:
    """(start, node, hop, rank): nodes within ``depth`` hops of each start, at most ``most`` of each (all without one).

    edges: (src, dst, rank), the best rank first; a node keeps the hop that reaches it first and its
    best rank there.  Hops are few, each one join with the frontier and one anti-join with what is seen.
    """
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hop"), F.lit(0).cast("bigint").alias("rank"))
    frontier, edges = seen, kept(edges)
    for hop in range(1, depth + 1):
        reached = frontier.select("start", F.col("node").alias("src")).join(edges, "src").groupBy("start", F.col("dst").alias("node")).agg(F.min("rank").cast("bigint").alias("rank"))
        frontier = kept(reached.join(seen.select("start", "node"), ["start", "node"], "left_anti").select("start", "node", F.lit(hop).alias("hop"), "rank"))
        seen = seen.unionByName(frontier)
    w = Window.partitionBy("start").orderBy("hop", "rank", "node")
    if most is None:
        return seen.filter("hop > 0")
    return seen.filter("hop > 0").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def name_edges(mentions: DataFrame, owners: DataFrame, most_owners: int = 6, designated: int = 2) -> DataFrame:
    """(src, dst, rank): files that a file's words name.  mentions: (src, key, n); owners: (key, dst).

    A name of more than ``most_owners`` files names none; else the ``designated`` nearest: more
    folders shared with the source, less deep, then by path.
    """
    few = owners.join(owners.groupBy("key").agg(F.count("*").alias("k")).filter(F.col("k") <= most_owners), "key")
    a, b = F.split("src", "/"), F.split("dst", "/")
    same = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(a), F.size(b))), lambda i: F.slice(a, F.lit(1), i) == F.slice(b, F.lit(1), i)))
    near = mentions.join(few, "key").filter("src <> dst").withColumn("shared", same).withColumn("deep", F.size(b))
    top = near.withColumn("p", F.row_number().over(Window.partitionBy("src", "key").orderBy(F.desc("shared"), "deep", "dst"))).filter(F.col("p") <= designated)
    scores = top.groupBy("src", "dst").agg(F.sum("n").alias("score"))
    return scores.select("src", "dst", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst")).alias("rank"))


def named_slice(mentions: DataFrame, owners: DataFrame, starts: DataFrame, depth: int, most: int, most_owners: int = 6, designated: int = 2) -> DataFrame:
    """(start, node, hop, rank, place): the bounded slice by names, where each hop designates anew.

    As ``name_edges``, but a name designates the nearest files that the start's slice doesn't hold
    yet, so edges depend on the start.  Hops are few; a full slice goes no further.
    """
    few = owners.distinct().join(owners.distinct().groupBy("key").agg(F.count("*").alias("k")).filter(F.col("k") <= most_owners), "key")
    a, b = F.split("src", "/"), F.split("dst", "/")
    same = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(a), F.size(b))), lambda i: F.slice(a, F.lit(1), i) == F.slice(b, F.lit(1), i)))
    named = kept(mentions.join(few, "key").filter("src <> dst").select("src", "key", "n", "dst", same.alias("shared"), F.size(b).alias("deep")))
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hop"), F.lit(0).cast("bigint").alias("rank"), F.lit(0).cast("bigint").alias("place")).distinct()
    frontier = seen
    for hop in range(1, depth + 1):
        fresh = frontier.select("start", F.col("node").alias("src")).join(named, "src").join(seen.select("start", F.col("node").alias("dst")), ["start", "dst"], "left_anti")
        near = Window.partitionBy("start", "src", "key").orderBy(F.desc("shared"), "deep", "dst")
        scores = fresh.withColumn("p", F.row_number().over(near)).filter(F.col("p") <= designated).groupBy("start", "src", "dst").agg(F.sum("n").alias("score"))
        ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("start", "src").orderBy(F.desc("score"), "dst")).cast("bigint"))
        reached = ranked.groupBy("start", F.col("dst").alias("node")).agg(F.min("rank").alias("rank"))
        held = seen.groupBy("start").agg(F.max("place").alias("held"))
        place = F.col("held") + F.row_number().over(Window.partitionBy("start").orderBy("rank", "node"))
        frontier = kept(reached.join(held, "start").select("start", "node", F.lit(hop).alias("hop"), "rank", place.alias("place")).filter(F.col("place") <= most))
        seen = seen.unionByName(frontier)
    return seen.filter("hop > 0")


def complete_link_merge(pairs: DataFrame) -> DataFrame:
    """(id, keeper): items merged greedily, the most similar first, where groups have no common owner and all are alike.

    pairs: (a, b, ga, gb, similarity, part); ``part`` is a connected component of the pairs, which
    bounds what one greedy fold sees.
    """

    def fold(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pd.concat([b.to_pandas() for b in batches]).sort_values(["similarity", "a", "b"], ascending=[False, True, True])
        alike = set(zip(p["a"], p["b"], strict=True))
        owner = dict(zip(p["a"], p["ga"], strict=True)) | dict(zip(p["b"], p["gb"], strict=True))
        group = {i: [i] for i in owner}
        of = {i: i for i in owner}
        for a, b in zip(p["a"], p["b"], strict=True):
            x, y = of[a], of[b]
            if x != y and not {owner[i] for i in group[x]} & {owner[j] for j in group[y]} and all((min(i, j), max(i, j)) in alike for i in group[x] for j in group[y]):
                for j in group.pop(y):
                    group[x].append(j)
                    of[j] = x
        yield pa.RecordBatch.from_pydict({"id": list(of), "keeper": [min(group[g]) for g in of.values()]})

    return pairs.groupBy("part").applyInArrow(fold, "id bigint, keeper bigint")


def with_parts(pairs: DataFrame) -> DataFrame:
    """Pairs with ``part``: the smallest id that they lead to, however long the chain."""
    from lexforge.operators.components import connected_components

    pairs = kept(pairs)
    return pairs.join(connected_components(pairs).select(F.col("id").alias("a"), F.col("root").alias("part")), "a")


def merged_rules(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """(keeper, copies, entities, confidence): groups of rules that say the same, each with the copy that stays.

    The copy stays whose feature owns a cited file, then one that a test or document backs, then the
    feature that reads the fewest files (none counts as most), then the first slug; it takes over the
    others' entities and the best confidence.  rules: (id, slug, owns, backed, files, entities,
    confidence).
    """
    groups = complete_link_merge(with_parts(pairs)).withColumnRenamed("keeper", "grp")
    files = F.when(F.col("files") > 0, F.col("files")).otherwise(F.lit((1 << 63) - 1))
    key = F.struct(~F.col("owns"), ~F.col("backed"), files, "slug")
    held = groups.join(rules, "id")
    xs = F.array_sort(F.collect_list(F.struct(key.alias("key"), F.col("entities").alias("e"))))
    g = held.groupBy("grp").agg(F.min_by("id", key).alias("keeper"), F.count("*").alias("n"), xs.alias("xs"), F.max("confidence").alias("confidence"))
    return g.filter("n > 1").select("keeper", (F.col("n") - 1).alias("copies"), F.array_distinct(F.flatten(F.transform("xs", lambda x: x["e"]))).alias("entities"), "confidence")


def settle_duplicates(claims: DataFrame, item: str, is_owner: str, pos: str) -> DataFrame:
    """Items that several hold stay with the owner, else with the first; holders left with nothing are gone."""
    w = Window.partitionBy(item).orderBy(F.desc(is_owner), pos)
    return claims.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
