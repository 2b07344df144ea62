"""What backs a statement: identifier queries, three pools of evidence, paragraphs of a section, statements that cover a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexforge.functions import text as T
from lexforge.operators import retrieval as R

# Characters of each pool, and of one extract.
POOLS = {"doc": 1200, "test": 900, "commit": 900}
EXTRACT, SEPARATOR = 400, 3


def route_name(name: Column) -> Column:
    """A route without verbs and placeholders; any other name as it is."""
    verbs, path = F.substring_index(name, " ", 1), F.regexp_extract(name, r"(?s)^[^ ]* (.*)$", 1)
    parts = F.filter(F.split(path, "[/ ]"), lambda s: (s != "") & ~s.rlike("^[:{<]"))
    return F.when(name.contains(" ") & verbs.rlike("^[A-Z]+(/[A-Z]+)*$"), F.array_join(parts, " ")).otherwise(name)


def identifier_queries(entry_points: Column, entities: Column) -> Column:
    """Names of entry points without file, verbs and placeholders, then entities; each once, blank ones left out."""
    names = F.transform(entry_points, lambda e: route_name(T.entry_point_name(e)))
    return F.array_distinct(F.filter(F.concat(names, entities), lambda x: F.trim(x) != ""))


def evidence_pools(signals: DataFrame, queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(pool, query, used, docs): of each pool, the signals closest to a query that fit its characters.  signals: (doc, pool, origin, text).

    The pools are three at most, each an index of its own, so weights don't mix.
    """
    from functools import reduce

    out = []
    for pool, budget in POOLS.items():
        mine = signals.filter(F.col("pool") == pool).select("doc", F.concat_ws(" ", "origin", "text").alias("text"), F.length("text").alias("chars"))
        hits = R.hits_of_any(R.build(mine, "doc", "text"), queries, id_col, text_col).join(mine.select("doc", "chars"), "doc")
        fit = R.greedy_fit(hits, ["query"], [F.desc("score"), F.col("doc")], F.least(F.col("chars"), F.lit(EXTRACT)) + SEPARATOR, budget)
        out.append(fit.select(F.lit(pool).alias("pool"), "query", "used", "docs"))
    return reduce(DataFrame.unionByName, out)


def paragraphs(text: Column) -> Column:
    """Paragraphs of a text: parted by blank lines outside fences."""
    parts = F.split(F.concat(text, F.lit("\n")), "\n")
    start = F.struct(F.lit(False).alias("fence"), F.lit("").alias("held"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, line: Column) -> Column:
        mark = F.ltrim(line).rlike("^(```|~~~)")
        fence = a["fence"] != mark
        blank = (F.trim(line) == "") & ~fence
        closed = F.concat(a["out"], F.when(a["held"] != "", F.array(a["held"])).otherwise(F.array().cast("array<string>")))
        held = F.when(a["held"] == "", line).otherwise(F.concat(a["held"], F.lit("\n"), line))
        return F.struct(fence.alias("fence"), F.when(blank, "").otherwise(held).alias("held"), F.when(blank, closed).otherwise(a["out"]).alias("out"))

    return F.aggregate(parts, start, step, lambda a: F.concat(a["out"], F.when(F.trim(a["held"]) != "", F.array(F.rtrim(a["held"]))).otherwise(F.array().cast("array<string>"))))


def paragraph_choice(ranked: DataFrame, key: str, share: int, overhead: int) -> DataFrame:
    """(key, paragraph): the paragraphs of a section that queries take in turn, the best first, while they fit.

    ranked: (key, query_no, rank, paragraph, chars).  Turns are a fold over a section's ranking: in
    each, a query takes its best paragraph that isn't taken and fits.  A paragraph costs ``overhead``
    at least, so a section gives no more than share / overhead of them and as many turns are folded.
    """
    xs = F.array_sort(F.collect_list(F.struct("query_no", "rank", "paragraph", F.col("chars").cast("bigint").alias("chars"))))
    g = ranked.groupBy(key).agg(xs.alias("xs"), F.count_distinct("query_no").alias("queries"))
    turns = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(share // overhead + 1)), lambda i: F.array_sort(F.array_distinct(F.transform("xs", lambda x: x["query_no"])))))
    start = F.struct(F.lit(share).cast("bigint").alias("left"), F.array().cast("array<int>").alias("taken"))

    def turn(a: Column, q: Column) -> Column:
        open_ = F.filter("xs", lambda x: (x["query_no"] == q) & ~F.array_contains(a["taken"], x["paragraph"]) & (x["chars"] + overhead <= a["left"]))
        best = F.get(open_, F.lit(0))
        return F.when(F.size(open_) > 0, F.struct((a["left"] - best["chars"] - overhead).alias("left"), F.concat(a["taken"], F.array(best["paragraph"])).alias("taken"))).otherwise(a)

    return g.select(key, F.explode(F.array_sort(F.aggregate(turns, start, turn, lambda a: a["taken"]))).alias("paragraph"))


def covering_statements(statements: DataFrame, wanted: DataFrame, id_col: str, text_col: str, top: int) -> DataFrame:
    """(query, place, doc): of each wanted rule, the closest statements, equal texts once.  statements: (doc, text)."""
    first = statements.groupBy("text").agg(F.min("doc").alias("doc"))
    hits = R.hits_of_any(R.build(statements, "doc", "text"), wanted, id_col, text_col).join(first.select("doc"), "doc", "left_semi")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return hits.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top).select("query", "place", "doc")
