"""Aggregations: counts, means that skip nulls, merges, rollups, recall and precision, spreads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexforge.functions import text as T


def mean_or_none(c: Column) -> Column:
    return F.avg(c)


def child_confidence(parents: DataFrame, children: DataFrame, key: str, score: str) -> DataFrame:
    """Mean of the scored children; 0 without children, null if none is scored; and ``k of n``."""
    per = children.groupBy(key).agg(F.avg(score).alias("mean"), F.count(score).alias("scored"), F.count("*").alias("n"))
    out = parents.select(key).join(per, key, "left")
    return out.select(key, F.when(F.col("n").isNull(), F.lit(0.0)).otherwise(F.col("mean")).alias("confidence"), F.concat_ws(" of ", F.coalesce("scored", F.lit(0)).cast("string"), F.coalesce("n", F.lit(0)).cast("string")).alias("rationale"))


def merge_entities(rows: DataFrame, name: str, path: str, size: str, description: str, attributes: str, pos: str) -> DataFrame:
    """One row a name without case: its home (a file named after it, then the richest, the longest description, the first) and the union of attributes, each where it first stands."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    home = F.max_by(F.struct(path, name, description), F.struct((T.normalize_name(stem) == T.normalize_name(F.col(name))).cast("int"), F.col(size), F.length(description), -F.col(pos)))
    lists = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(attributes).alias("a"))))
    merged = rows.groupBy(F.lower(name).alias("key")).agg(home.alias("home"), F.array_distinct(F.flatten(F.transform(lists, lambda x: x["a"]))).alias("attributes"), F.count("*").alias("mentions"))
    return merged.select("key", F.col(f"home.{name}").alias("name"), F.col(f"home.{path}").alias("home"), F.col(f"home.{description}").alias("description"), "attributes", "mentions")


def usage_rollup(usage: DataFrame, dims: list[str], sums: list[str]) -> DataFrame:
    """Totals at every level of the dimensions, with the level's number of dimensions."""
    level = sum((1 - F.grouping(d) for d in dims), F.lit(0)).cast("int")
    return usage.rollup(*dims).agg(level.alias("level"), *[F.sum(s).alias(s) for s in sums])


def directory_rollup(files: DataFrame, path: str, flag: str) -> DataFrame:
    """Cited and all files of every directory, the root as an empty path."""
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return files.select(F.explode(prefixes).alias("directory"), F.col(flag).alias("flag")).groupBy("directory").agg(F.count("*").alias("files"), F.count_if("flag").alias("cited"))


def heat_map(rows: DataFrame, a: str, b: str, kinds: list[str]) -> DataFrame:
    """Counts of every pair of a group and a kind (none left out), with a level of 0 to 4 by the largest."""
    cells = rows.select(a).distinct().crossJoin(F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in kinds], f"`{b}` string")))
    n = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    most = n.agg(F.max("n").alias("most"))
    out = cells.join(n, [a, b], "left").crossJoin(F.broadcast(most)).withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select(a, b, "n", F.ceil(4 * F.col("n") / F.col("most")).cast("int").alias("level"))


def recall_precision(made: DataFrame, wanted: DataFrame, pairs: DataFrame, name: str = "name") -> DataFrame:
    """Shares of wanted items that something made matches and of made items that match, by normalized name or a given pair; null without any."""
    m = made.select(F.col(name).alias("made"), T.normalize_name(F.col(name)).alias("key")).distinct()
    w = wanted.select(F.col(name).alias("wanted"), T.normalize_name(F.col(name)).alias("key")).distinct()
    hits = m.join(w, "key").select("made", "wanted").unionByName(pairs.select("made", "wanted").join(m.select("made"), "made", "left_semi").join(w.select("wanted"), "wanted", "left_semi")).distinct()
    h = hits.agg(F.count_distinct("wanted").alias("found"), F.count_distinct("made").alias("right"))
    out = h.crossJoin(m.agg(F.count_distinct("made").alias("made"))).crossJoin(w.agg(F.count_distinct("wanted").alias("wanted")))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.select("found", "right", "made", "wanted", share("found", "wanted").alias("recall"), share("right", "made").alias("precision"))


def confusion(rows: DataFrame, good: Column, dropped: Column, known: Column) -> DataFrame:
    return rows.agg(F.count_if(known).alias("labelled"), F.count_if(known & good).alias("good"), F.count_if(known & good & dropped).alias("good_dropped"), F.count_if(known & ~good).alias("noise"), F.count_if(known & ~good & dropped).alias("noise_dropped"), F.count_if(~known).alias("missing"))


def ratio_spread(rows: DataFrame, outer: list[str], inner: list[str], amount: str, unit: str) -> DataFrame:
    """Median, least and most of the inner groups' sum ratios, rounded to three decimals first."""
    one = rows.groupBy(*outer, *inner).agg(F.round(F.sum(amount) / F.nullif(F.sum(unit), F.lit(0)), 3).alias("ratio"))
    return one.groupBy(*outer).agg(F.median("ratio").alias("median"), F.min("ratio").alias("least"), F.max("ratio").alias("most"), F.count("ratio").alias("n"))


def series_summary(rows: DataFrame, series: str, figures: list[str]) -> DataFrame:
    """Mean, least, most and number of every figure of every series, and the change of the mean from the series before."""
    tall = rows.unpivot([series], figures, "figure", "value")
    s = tall.groupBy(series, "figure").agg(F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("value").alias("n"))
    return s.withColumn("change", F.col("mean") - F.lag("mean").over(Window.partitionBy("figure").orderBy(series)))


def most_frequent(rows: DataFrame, value: str, override: str | None = None) -> DataFrame:
    """The override if it occurs, else the most frequent value (the last in order of equals)."""
    n = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    first = F.col(value) == F.lit(override) if override else F.lit(False)
    return n.agg(F.max_by(value, F.struct(first, "n", value)).alias("pick"))
