"""Figures of runs and selections under budgets: shares, yields, scores without disputed items, merged chunks, ranges, samples, excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexforge.operators.rollups import recall_precision

LEAST_SAMPLE, MOST_SAMPLE, HEADER = 150, 1500, 8


def merge_chunk_entities(rows: DataFrame, path: str, name: str, pos: str, description: str, attributes: str) -> DataFrame:
    """One row a file and exact name: the first description that isn't blank, attributes each where it first stands."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(description).alias("d"), F.col(attributes).alias("a"))))
    g = rows.groupBy(path, name).agg(ordered.alias("xs"))
    said = F.filter("xs", lambda x: F.coalesce(F.trim(x["d"]), F.lit("")) != "")
    return g.select(path, name, F.get(said, F.lit(0))["d"].alias(description), F.array_distinct(F.flatten(F.transform("xs", lambda x: x["a"]))).alias(attributes))


def coverage_shares(counts: DataFrame, current: DataFrame, kind: str = "kind", key: str = "id") -> DataFrame:
    """(kind, count, total, share): sums over the holders that still exist; null of nothing."""
    kept = counts.join(current, [kind, key], "left_semi")
    s = kept.groupBy(kind).agg(F.sum("count").alias("count"), F.sum("total").alias("total"))
    return s.withColumn("share", F.when(F.col("total") > 0, F.round(F.col("count") / F.col("total"), 6)))


def score_undisputed(made: DataFrame, wanted: DataFrame, pairs: DataFrame, disputed: DataFrame) -> DataFrame:
    """Recall and precision over what nobody disputes.  disputed: (side, name), side being made or wanted."""
    drop = lambda rows, side: rows.join(disputed.filter(F.col("side") == side).select("name"), "name", "left_anti")
    return recall_precision(drop(made, "made"), drop(wanted, "wanted"), pairs)


def yields(units: DataFrame, by: str = "application") -> DataFrame:
    """(application, yield, value): ratios over the units of an application's runs summed, rounded to three decimals; null over nothing."""
    names = [c for c in units.columns if c not in (by, "run")]
    s = units.groupBy(by).agg(F.count("*").alias("runs"), *[F.sum(c).alias(c) for c in names])
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 3))
    c = F.col
    table = {
        "source files per run": ratio(c("source_files"), c("runs")),
        "characters per business file": ratio(c("business_chars"), c("business_files")),
        "characters per entry point file": ratio(c("entry_point_chars"), c("entry_point_files")),
        "entry points per file read": ratio(c("entry_points"), c("business_files") + c("entry_point_files")),
        "domains per run": ratio(c("domains"), c("runs")),
        "entry points per domain": ratio(c("entry_points"), c("domains")),
        "features per domain": ratio(c("features"), c("domains")),
        "use cases per feature": ratio(c("use_cases"), c("features")),
        "reconciled items per feature": F.when(c("reconcile_items") > 0, ratio(c("reconcile_items"), c("features"))),
    }
    return s.select(by, F.inline(F.array(*[F.struct(F.lit(k).alias("yield"), v.alias("value")) for k, v in table.items()])))


def file_ranges(items: DataFrame, group: str, pos: str, file: str, limit: int) -> DataFrame:
    """(group, start, end): slices of a group's items (those of a file stand together), whole files up to ``limit`` items; a file over the limit is cut and stands alone.

    Files are counted first, so the fold sees one entry a file.
    """
    runs = items.groupBy(group, file).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    xs = F.transform(F.array_sort(F.collect_list(F.struct("first", "n"))), lambda x: x["n"])
    ranges = "array<struct<start:bigint,end:bigint>>"
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("start"), zero.alias("at"), F.array().cast(ranges).alias("out"))
    one = lambda a, z: F.array(F.struct(a.alias("start"), z.alias("end")))
    none = F.array().cast(ranges)

    def step(a: Column, n: Column) -> Column:
        to = a["at"] + n
        open_ = F.when(a["start"] < a["at"], one(a["start"], a["at"])).otherwise(none)
        cuts = F.transform(F.sequence(zero, F.floor((n - 1) / limit)), lambda i: F.struct((a["at"] + i * limit).alias("start"), F.least(a["at"] + (i + 1) * limit, to).alias("end")))
        over, full = n > limit, to - a["start"] > limit
        return F.struct(F.when(over, to).when(full, a["at"]).otherwise(a["start"]).alias("start"), to.alias("at"), F.concat(a["out"], F.when(over, F.concat(open_, cuts)).when(full, open_).otherwise(none)).alias("out"))

    finish = lambda a: F.concat(a["out"], F.when(a["start"] < a["at"], one(a["start"], a["at"])).otherwise(none))
    return runs.groupBy(group).agg(xs.alias("xs")).select(group, F.inline(F.aggregate("xs", start, step, finish)))


def pick_samples(signals: DataFrame, group: str, pos: str, origin: str, text: str, budget: int) -> DataFrame:
    """(group, pos, chars): signals of each kind in order, each cut to an equal slice of the budget (150 to 1,500 characters) with its header's cost, until one doesn't fit.

    Each costs 9 characters at least, so no more than the budget's ninth can be picked: a group's
    first so many are folded.
    """
    most = budget // (HEADER + 1) + 1
    n = F.count("*").over(Window.partitionBy(group))
    cut = F.greatest(F.lit(LEAST_SAMPLE), F.least(F.lit(MOST_SAMPLE), F.floor(F.lit(budget) / n)))
    rows = signals.select(group, pos, (F.length(origin) + HEADER).cast("bigint").alias("head"), F.length(text).cast("bigint").alias("chars"), cut.cast("bigint").alias("slice"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy(pos))).filter(F.col("n") <= most)
    xs = F.array_sort(F.collect_list(F.struct("n", F.col(pos).alias("pos"), "head", "chars", "slice")))
    kept = f"array<struct<pos:{signals.schema[pos].dataType.simpleString()},chars:bigint>>"
    start = F.struct(F.lit(budget).cast("bigint").alias("left"), F.lit(False).alias("full"), F.array().cast(kept).alias("out"))

    def step(a: Column, x: Column) -> Column:
        room = a["left"] - x["head"]
        chars = F.least(x["chars"], x["slice"], room)
        fits = ~a["full"] & (room > 0) & (chars > 0)
        more = F.array(F.struct(x["pos"].alias("pos"), chars.alias("chars")))
        return F.when(fits, F.struct((room - chars).alias("left"), F.lit(False).alias("full"), F.concat(a["out"], more).alias("out"))).otherwise(F.struct(a["left"].alias("left"), F.lit(True).alias("full"), a["out"].alias("out")))

    return rows.groupBy(group).agg(xs.alias("xs")).select(group, F.inline(F.aggregate("xs", start, step, lambda a: a["out"])))


def excerpt_score(chunk: Column, first: Column, last: Column, terms: Column, words: Column, lines: Column) -> Column:
    """What a chunk is worth: a cited line before names before words.  lines: array<struct<a,z>>."""
    low = F.lower(chunk)
    held = lambda xs: F.size(F.filter(xs, lambda t: F.contains(low, t)))
    cited = F.exists(lines, lambda r: (r["a"] <= last) & (r["z"] >= first))
    return F.when(cited, 100_000).otherwise(0) + 100 * held(terms) + held(words)


def excerpt_choice(chunks: DataFrame, key: str, nth: str, size: str, score: str, budget: int) -> DataFrame:
    """(key, nth): the first chunk of each file and then the best, while they fit; one that doesn't is skipped.  Files have few chunks (their splitter bounds them)."""
    xs = F.array_sort(F.collect_list(F.struct(F.when(F.col(nth) == 0, 0).otherwise(1).alias("later"), (-F.col(score)).alias("worth"), F.col(nth).alias("nth"), F.col(size).cast("bigint").alias("size"))))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("out"))
    step = lambda a, x: F.when(a["used"] + x["size"] <= budget, F.struct((a["used"] + x["size"]).alias("used"), F.concat(a["out"], F.array(x["nth"].cast("int"))).alias("out"))).otherwise(a)
    return chunks.groupBy(key).agg(xs.alias("xs")).select(key, F.explode(F.aggregate("xs", start, step, lambda a: a["out"])).alias("nth"))


def estimate_accuracy(runs: DataFrame, by: str) -> DataFrame:
    """Per pass: runs, those within their range, above, below, and the mean ratio of the measure to the middle of the range.  runs: (by, low, high, measured)."""
    middle = (F.col("low") + F.col("high")) / 2
    return runs.groupBy(by).agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("measured").between(F.col("low"), F.col("high"))).alias("within"),
        F.count_if(F.col("measured") > F.col("high")).alias("above"),
        F.count_if(F.col("measured") < F.col("low")).alias("below"),
        F.round(F.avg(F.when(middle > 0, F.col("measured") / middle)), 6).alias("ratio"),
    )


def read_coverage(read: DataFrame, wanted: DataFrame, key: str = "path") -> DataFrame:
    """One row: files read, wanted, both; recall and noise, 0 over nothing."""
    r, w = read.select(key).distinct(), wanted.select(key).distinct()
    both = r.withColumn("r", F.lit(1)).join(w.withColumn("w", F.lit(1)), key, "full_outer").agg(F.count("r").alias("read"), F.count("w").alias("wanted"), F.count_if(F.col("r").isNotNull() & F.col("w").isNotNull()).alias("both"))
    share = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)
    return both.withColumn("recall", share(F.col("both"), F.col("wanted"))).withColumn("noise", share(F.col("read") - F.col("both"), F.col("read")))


def water_shares(rows: DataFrame, group: str, kind: str, need: str, share: str, total: int) -> DataFrame:
    """(group, kind, given): a budget over kinds by their shares; a kind that needs less takes its need, and the rest goes to the others.

    Kinds are taken by need over share: once one needs more than its part, so do all after it, and
    these part what is left.  A group has a handful of kinds.
    """
    xs = F.array_sort(F.collect_list(F.struct((F.col(need) / F.col(share)).alias("thirst"), F.col(kind).alias("kind"), F.col(need).cast("double").alias("need"), F.col(share).cast("double").alias("share"))))
    g = rows.filter(F.col(share) > 0).groupBy(group).agg(xs.alias("xs"), F.sum(F.col(share).cast("double")).alias("weight"))
    kept = f"array<struct<kind:{rows.schema[kind].dataType.simpleString()},given:double>>"
    start = F.struct(F.lit(float(total)).alias("left"), F.col("weight").alias("weight"), F.array().cast(kept).alias("out"))

    def step(a: Column, x: Column) -> Column:
        given = F.least(x["need"], F.when(a["weight"] > 0, a["left"] * x["share"] / a["weight"]).otherwise(0.0))
        return F.struct((a["left"] - given).alias("left"), (a["weight"] - x["share"]).alias("weight"), F.concat(a["out"], F.array(F.struct(x["kind"].alias("kind"), given.alias("given")))).alias("out"))

    return g.select(group, F.inline(F.aggregate("xs", start, step, lambda a: a["out"]))).select(group, F.col("kind").alias(kind), F.round("given", 6).alias("given"))


def duration(seconds: Column) -> Column:
    """Minutes, or seconds below one: ``6 min``, ``45 s``; hours and minutes from one on."""
    minutes = F.floor((seconds + 30) / 60)
    text = lambda c: c.cast("string")
    long = F.concat(text(F.floor(minutes / 60)), F.lit(" h "), F.lpad(text(minutes % 60), 2, "0"))
    return F.when(seconds < 60, F.concat(text(seconds), F.lit(" s"))).when(minutes < 60, F.concat(text(minutes), F.lit(" min"))).otherwise(long)
