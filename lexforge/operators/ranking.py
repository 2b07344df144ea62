"""Ranking, budgets, samples, islands, trends: window-shaped operators with total orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexforge.operators.graphs import kept

# What an item of a kind weighs.
# The weight of each kind of debt, in the order in which the kinds are listed.
DEBT_WEIGHTS = {
    "low_confidence": 1.0,
    "not_scored": 0.5,
    "unbacked_narrative": 1.0,
    "technical_language": 0.5,
    "set_apart": 0.25,
    "stale": 1.0,
    "contradicted": 1.0,
    "undocumented": 0.5,
    "marked_wrong": 1.0,
    "to_review": 0.5,
    "outdated_edit": 0.5,
    "entry_point_without_feature": 0.5,
    "no_domain": 0.25,
    "no_behaviour": 0.25,
    "not_analysed": 0.25,
}


def file_score(weight: Column, commits: Column, references: Column) -> Column:
    cap = lambda c: F.least(c, F.lit(65535)).cast("double")
    return weight * (1 + F.log1p(cap(commits)) + F.log1p(cap(references)))


def debt_priority(weight: Column, score: Column, commits: Column, entry_points: Column) -> Column:
    return weight * F.coalesce(1 - score, F.lit(1.0)) * (1 + F.log1p(commits.cast("double"))) * (1 + F.log1p(entry_points.cast("double")))


def budget(rows: DataFrame, order: list[Column], n: int, group: list[str] | None = None) -> DataFrame:
    """Adds ``kept``: whether a row is among the first n of its group.  Without a group, the limit's rows are found by a distributed top-n."""
    if group:
        return rows.withColumn("kept", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) <= n)
    key = rows.columns[0]
    top = rows.orderBy(*order).limit(n).select(key).withColumn("kept", F.lit(True))
    return rows.join(top, key, "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def global_rank(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds each row's place in a total order of all rows.

    Rows go to ranges of the order, which are kept so that they can't move; a place is the row's
    number in its range after the rows of the ranges before, so no task sees all rows.
    """
    ranges = kept(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    before, sizes = 0, []
    for r in ranges.groupBy("__p").agg(F.count("*").alias("n")).orderBy("__p").collect():
        sizes.append((r["__p"], before))
        before += r["n"]
    starts = rows.sparkSession.createDataFrame(sizes, "__p int, __s bigint")
    placed = ranges.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    return placed.join(F.broadcast(starts), "__p").withColumn(name, F.col("__s") + F.col("__n")).drop("__p", "__s", "__n")


def evenly_spaced(rows: DataFrame, group: list[str], order: list[Column], count: int) -> DataFrame:
    """``count`` rows of each group at even distances."""
    w = Window.partitionBy(*group)
    r = F.row_number().over(w.orderBy(*order)) - 1
    total = F.count("*").over(w)
    c = F.least(F.lit(count).cast("bigint"), total)
    out = rows.withColumn("__r", r).withColumn("__n", total).withColumn("__c", c)
    return out.filter(F.expr("(__r * __c) div __n <> ((__r + 1) * __c) div __n")).drop("__r", "__n", "__c")


def islands(rows: DataFrame, group: list[str], order: list[Column], value: str, most: int) -> DataFrame:
    """Adds ``island`` (runs of one value) and ``batch`` (at most ``most`` rows of a run)."""
    w = Window.partitionBy(*group).orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    out = rows.withColumn("__c", changed).withColumn("island", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*group, "island").orderBy(*order)
    return out.withColumn("batch", F.floor((F.row_number().over(inside) - 1) / most)).drop("__c")


def fitting_prefix(rows: DataFrame, group: list[str], order: list[Column], cost: str, limit: float) -> DataFrame:
    """Rows in order until the first that doesn't fit; the first row always."""
    w = Window.partitionBy(*group).orderBy(*order)
    out = rows.withColumn("__s", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.row_number().over(w))
    over = F.max(F.when((F.col("__s") > limit) & (F.col("__n") > 1), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("__o", over).filter("__o = 0").drop("__s", "__n", "__o")


def recent_within(rows: DataFrame, group: list[str], newest_first: list[Column], size: str, limit: int) -> DataFrame:
    """The newest rows whose sizes together stay within the limit: the oldest are dropped first."""
    w = Window.partitionBy(*group).orderBy(*newest_first).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__s", F.sum(size).over(w)).filter(F.col("__s") <= limit).drop("__s")


def trend_flags(rows: DataFrame, group: list[str], run: str, figure: str, lower_is_worse: bool) -> DataFrame:
    """Each run's figure in rounded percent (ties to even) beside the one before; worse if it moved the wrong way, never for a null."""
    out = rows.withColumn("shown", F.bround(F.col(figure) * 100, 0))
    w = Window.partitionBy(*group).orderBy(run)
    before = F.lag("shown").over(w)
    worse = F.col("shown") < before if lower_is_worse else F.col("shown") > before
    return out.withColumn("before", before).withColumn("worse", F.coalesce(worse, F.lit(False)))


def run_diff(old: DataFrame, new: DataFrame, keys: list[str], score: str = "score", fall: float = 0.2) -> DataFrame:
    """Sections of two runs: added, removed, degraded (a known score fell by ``fall`` or more) or same."""
    o, n = old.select(*keys, F.col(score).alias("old_score"), F.lit(1).alias("o")), new.select(*keys, F.col(score).alias("new_score"), F.lit(1).alias("n"))
    state = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("old_score") - F.col("new_score") >= fall - 1e-6, "degraded").otherwise("same")
    return o.join(n, keys, "full_outer").select(*keys, "old_score", "new_score", state.alias("state"))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The newest record of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def saved_order(rows: DataFrame, key: str, pos: str, old_pos: str) -> DataFrame:
    """Rows known before keep their former order in the places they hold; ``old_pos`` is null for new rows.  Both orders are ranked by ranges, so no task sees all rows."""
    held = rows.filter(F.col(old_pos).isNotNull()).select(key, pos, old_pos)
    slots = global_rank(held.select(F.col(pos).alias("__slot")), [F.col("__slot")], "__k")
    olds = global_rank(held, [F.col(old_pos), F.col(pos)], "__k").select(key, "__k")
    moved = olds.join(slots, "__k").select(key, "__slot")
    return rows.join(moved, key, "left").withColumn("place", F.coalesce("__slot", pos)).drop("__slot")


def batches(rows: DataFrame, group: list[str], order: list[Column], size: str, limit: int) -> DataFrame:
    """Rows in order packed into batches of at most ``limit``; a larger row is alone.  Groups are folded one by one."""
    pos = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    listed = rows.select(*group, F.struct(pos.alias("pos"), F.col(size).cast("bigint").alias("size")).alias("x")).groupBy(*group).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    start = F.struct(F.lit(-1).cast("bigint").alias("batch"), F.lit(0).cast("bigint").alias("used"), F.array().cast("array<struct<pos:int,size:bigint,batch:bigint>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        fits = (a["batch"] >= 0) & (a["used"] + x["size"] <= limit)
        b = F.when(fits, a["batch"]).otherwise(a["batch"] + 1)
        return F.struct(b.alias("batch"), F.when(fits, a["used"] + x["size"]).otherwise(x["size"]).alias("used"), F.concat(a["out"], F.array(F.struct(x["pos"].alias("pos"), x["size"].alias("size"), b.alias("batch")))).alias("out"))

    return listed.select(*group, F.inline(F.aggregate("xs", start, step, lambda a: a["out"])))
