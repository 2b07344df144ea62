"""Lexical retrieval: an inverted index as two tables, and BM25 for one query or many at once.

The index is (term, doc, tf) and (doc, length).  Queries are a table too, so a single query and a
million run the same plan: the query terms meet the postings by an equi-join on the term, which
keeps only the postings that some query needs, and one aggregation by (query, doc) scores them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexforge.functions import text as T
from lexforge.operators.graphs import kept

K1, B, FLOOR = 1.2, 0.75, 0.5 * (1 + 1e-5)


@dataclass
class Index:
    tokens: DataFrame  # doc, length, term: a row a token, one with a null term for a document without any
    lengths: DataFrame  # doc, length: tokens, stop words included

    @property
    def postings(self) -> DataFrame:
        """term, doc, tf, length of the doc (so that scoring needs no join for it)."""
        return self.tokens.filter("term is not null").groupBy("term", "doc", "length").agg(F.count("*").alias("tf"))


def build(docs: DataFrame, id_col: str, text_col: str) -> Index:
    tokens = docs.select(F.col(id_col).alias("doc"), T.search_tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("tokens"))
    length = F.size("tokens").cast("bigint").alias("length")
    # Outer: else the optimizer tests for an empty array first, and so splits every text once more.
    return Index(tokens.select("doc", length, F.explode_outer("tokens").alias("term")), tokens.select("doc", length))


def weighted_text(title: Column, body: Column, times: int = 3) -> Column:
    """The title counts as often as it is repeated before the text."""
    return F.concat_ws("\n", *[title] * times, body)


def vocabulary(index: Index) -> DataFrame:
    """(term, df, cf)."""
    return index.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def idf(total: Column, df: Column) -> Column:
    return F.log(1 + (total - df + 0.5) / (df + 0.5))


def query_table(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query, term, terms): distinct content terms, with their number."""
    q = queries.select(F.col(id_col).alias("query"), T.query_terms(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    return q.select("query", F.explode("t").alias("term"), F.size("t").alias("terms"))


def score(index: Index, terms: DataFrame) -> DataFrame:
    """(query, doc, matched, score, held, terms, weight) of every document that has a query term."""
    stats = index.lengths.agg(F.count("*").cast("double").alias("n"), F.avg("length").alias("mean"))
    wanted = terms.select("term").distinct()
    # Tokens that no query has are left at the scan; what is left is counted once and read twice.
    hits = kept(index.tokens.join(wanted, "term", "left_semi").groupBy("term", "doc", "length").agg(F.count("*").alias("tf")))
    df = hits.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    known = terms.join(df, "term", "left").crossJoin(F.broadcast(stats)).withColumn("idf", idf(F.col("n"), F.coalesce("df", F.lit(0.0))))
    weight = known.groupBy("query").agg(F.sum("idf").alias("weight"))
    tf, length = F.col("tf"), F.col("length") / F.col("mean")
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length))
    found = known.join(hits, "term").groupBy("query", "doc").agg(F.count("*").alias("matched"), F.sum(part).alias("score"), F.sum("idf").alias("held"), F.first("terms").alias("terms"))
    return found.join(weight, "query")


def half_rule() -> Column:
    return F.col("matched") * 2 >= F.col("terms")


def relevant_rule() -> Column:
    return half_rule() & (F.col("held") > F.col("weight") * FLOOR)


def ranked(scored: DataFrame, top: int | None = None) -> DataFrame:
    """Adds ``rank`` by score; the score is rounded first, so that sums in another order rank alike; ties by doc."""
    rounded = scored.withColumn("score", F.round("score", 6))
    out = rounded.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc")))
    return out.filter(F.col("rank") <= top) if top else out


def search(index: Index, queries: DataFrame, id_col: str, text_col: str, rule: str = "relevant", top: int | None = 10) -> DataFrame:
    scored = score(index, query_table(queries, id_col, text_col))
    rules = {"any": F.lit(True), "half": half_rule(), "relevant": relevant_rule()}
    return ranked(scored.filter(rules[rule]), top).select("query", "rank", "doc", "matched", "score")


def hits_of_any(index: Index, queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query, doc, score) of every document that has a query term; unranked, so that no task holds a query's hits."""
    return score(index, query_table(queries, id_col, text_col)).select("query", "doc", F.round("score", 6).alias("score"))


def left_out(index: Index, queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query, hits, left_out): how many the half rule finds, and how many of them the weight floor drops."""
    scored = score(index, query_table(queries, id_col, text_col)).filter(half_rule())
    return scored.groupBy("query").agg(F.count_if(relevant_rule()).alias("hits"), F.count_if(~relevant_rule()).alias("left_out"))


def unknown_words(index: Index, queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(query, word): query words, as written and once, of which no term is a stop word or known."""
    words = queries.select(F.col(id_col).alias("query"), F.posexplode(F.array_distinct(F.filter(F.split(F.col(text_col), r"[^\p{L}\p{N}]+"), lambda w: w != ""))).alias("pos", "word"))
    terms = words.select("query", "pos", "word", F.explode(T.search_tokens(F.col("word"))).alias("term"))
    known = index.postings.select("term").distinct().withColumn("known", F.lit(True))
    judged = terms.join(known, "term", "left").groupBy("query", "pos", "word").agg(F.max(F.coalesce("known", F.lit(False)) | T.is_stop(F.col("term"))).alias("seen"))
    return judged.filter(~F.col("seen")).select("query", "pos", "word")


def fused(index: Index, queries: DataFrame, item_col: str, id_col: str, text_col: str, top: int = 3) -> DataFrame:
    """Per item, documents that most of its queries find, then by best score, then by doc."""
    scored = score(index, query_table(queries, id_col, text_col)).filter(half_rule()).withColumn("score", F.round("score", 6))
    owners = queries.select(F.col(id_col).alias("query"), F.col(item_col).alias("item"))
    by_item = scored.join(owners, "query").groupBy("item", "doc").agg(F.count_distinct("query").alias("queries"), F.max("score").alias("best"))
    w = Window.partitionBy("item").orderBy(F.desc("queries"), F.desc("best"), "doc")
    return by_item.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def greedy_fit(hits: DataFrame, keys: list[str], order: list[Column], cost: Column, budget: int) -> DataFrame:
    """Per key, rows in order while they fit; one that doesn't is skipped, not a stop.

    Once a row of some cost is skipped, no later one of that cost fits; so of each cost only as many
    as the budget holds are folded (about budget * ln(budget) rows a key), and nothing is lost by
    that.  They are found in parts of each key first, so a busy key spreads.
    """
    held = F.least(F.col("__cost"), F.lit(budget + 1))
    rows = hits.withColumn("__cost", cost.cast("bigint")).withColumn("__part", F.pmod(F.hash("doc"), F.lit(64)))
    for by in ([*keys, held, F.col("__part")], [*keys, held]):
        n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        rows = rows.withColumn("__n", n).filter((F.col("__cost") <= 0) | (F.col("__n") <= F.greatest(F.expr(f"{budget} div __cost"), F.lit(1))))
    row = F.struct(F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias("pos"), F.col("doc").alias("doc"), F.col("__cost").alias("cost"))
    lists = rows.select(*keys, row.alias("x")).groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("docs"))
    step = lambda a, x: F.when(a["used"] + x["cost"] <= budget, F.struct((a["used"] + x["cost"]).alias("used"), F.concat(a["docs"], F.array(x["doc"])).alias("docs"))).otherwise(a)
    folded = lists.select(*keys, F.aggregate("xs", start, step).alias("a"))
    return folded.select(*keys, F.col("a.used").alias("used"), F.col("a.docs").alias("docs"))
