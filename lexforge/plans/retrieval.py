"""Queries of the retrieval family."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexforge.functions import text as T
from lexforge.operators import retrieval as R
from lexforge.plans import sqltext as S
from lexforge.plans.registry import query

ONE = "how is the attion thanedble anea with eriner thanea"
_DOCS = "select doc_id as doc, text from documents"
_ONE = f"select 1 as query, '{ONE}' as text"


def _index(t):
    return R.build(t.documents, "doc_id", "text")


def _one(t):
    return t.spark.range(1).select(F.lit(1).alias("query"), F.lit(ONE).alias("text"))


def _bench(t):
    return t.benchmark.select("item_id", "text")


_BENCH = "select item_id as query, text from benchmark"

query("postings", f"with tok as (select doc_id, unnest({S.tokens('text')}) as term from documents) select term, doc_id as doc, count(*) as tf from tok group by all")(lambda t: _index(t).postings.drop("length"))
query("doc_lengths", f"select doc_id as doc, len({S.tokens('text')}) as length from documents")(lambda t: _index(t).lengths)
query("vocabulary_df", f"with tok as (select doc_id, unnest({S.tokens('text')}) as term from documents), p as (select term, doc_id, count(*) as tf from tok group by all) select term, count(*) as df, sum(tf) as cf from p group by term")(lambda t: R.vocabulary(_index(t)))

for _name, _rule, _where in (("bm25_search", "half", S.HALF), ("bm25_search_any", "any", "true"), ("bm25_relevant", "relevant", S.RELEVANT)):
    query(_name, f"with {S.scored(_DOCS, _ONE)} {S.ranked('s', _where, 20)}")(lambda t, r=_rule: R.search(_index(t), _one(t), "query", "text", r, 20))

query("bm25_batch_match", f"with {S.scored(_DOCS, _BENCH)} {S.ranked('s', S.HALF, 3)}")(lambda t: R.search(_index(t), _bench(t), "item_id", "text", "half", 3))
query("bm25_left_out", f"with {S.scored(_DOCS, _BENCH)} select query, count(*) filter (where {S.RELEVANT}) as hits, count(*) filter (where not ({S.RELEVANT})) as left_out from s where {S.HALF} group by query")(lambda t: R.left_out(_index(t), _bench(t), "item_id", "text"))


@query("bm25_unknown_words", f"""
with q as (select conv_id * 1000 + turn as query, text from conversations where text is not null),
w as (select query, unnest(list_transform(range(len(ws)), lambda i: {{'pos': i, 'word': ws[i + 1]}})) as x from (select query, array_agg(w order by p) as ws from (select query, w, min(p) as p from (select query, unnest(ws) as w, generate_subscripts(ws, 1) as p from (select query, list_filter(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') as ws from q)) group by query, w) group by query)),
v as (select distinct unnest({S.tokens('text')}) as term from documents),
k as (select query, x.pos as pos, x.word as word, unnest({S.tokens('x.word')}) as term from w)
select query, cast(pos as int) as pos, word from k left join v on k.term = v.term group by query, pos, word having not bool_or(v.term is not null or k.term in ({S.listing(T.stop_terms())}))""")
def unknown_words(t):
    q = t.conversations.filter("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return R.unknown_words(_index(t), q, "id", "text")


_FUSED = """select item_id * 1000 + n as query, part as text, item_id as item from (select item_id, generate_subscripts(ps, 1) - 1 as n, unnest(ps) as part from (select item_id, string_split(text, '.') as ps from benchmark)) where trim(part) <> ''"""


@query("bm25_fused", f"with {S.scored(_DOCS, _FUSED)}, o as ({_FUSED}), i as (select item, doc, count(distinct query) as queries, max(round(score, 6)) as best from s join o using (query) where {S.HALF} group by item, doc) select item, doc, queries, best, row_number() over (partition by item order by queries desc, best desc, doc) as rank from i qualify rank <= 3")
def fused(t):
    parts = t.benchmark.select("item_id", F.posexplode(F.split("text", r"\.")).alias("n", "part")).filter(F.trim("part") != "")
    queries = parts.select(F.col("item_id").alias("item"), (F.col("item_id") * 1000 + F.col("n")).alias("query"), "part")
    return R.fused(_index(t), queries, "item", "query", "part")


_PAGES = r"""select page_id as doc, concat_ws(chr(10), title, title, title, body) as text from (select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, regexp_replace(html, '<[^>]*>', ' ', 'g') as body from pages)"""


@query("title_weighted_search", f"with {S.scored(_PAGES, _BENCH)} {S.ranked('s', S.RELEVANT, 5)}")
def title_search(t):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    pages = t.pages.select("page_id", R.weighted_text(title, F.regexp_replace("html", "<[^>]*>", " ")).alias("text"))
    return R.search(R.build(pages, "page_id", "text"), _bench(t), "item_id", "text", "relevant", 5)


@query("evidence_fit", f"""with recursive {S.scored(_DOCS, _BENCH)}, r as (select query, doc, least(length(text), 400) + 3 as cost, row_number() over (partition by query order by round(score, 6) desc, doc) as k from s join documents on doc = doc_id),
f as (select query, 0::bigint as k, 0::bigint as used, []::bigint[] as docs from (select distinct query from r) union all
  select f.query, r.k, case when used + cost <= 1200 then used + cost else used end, case when used + cost <= 1200 then list_append(docs, r.doc) else docs end from f join r on r.query = f.query and r.k = f.k + 1)
select query, max(used) as used, max_by(docs, k) as docs from f group by query""")
def evidence(t):
    hits = R.hits_of_any(_index(t), _bench(t), "item_id", "text").join(t.documents.select(F.col("doc_id").alias("doc"), F.length("text").alias("chars")), "doc")
    return R.greedy_fit(hits, ["query"], [F.desc("score"), F.col("doc")], F.least(F.col("chars"), F.lit(400)) + 3, 1200)


_STRIPPED = "regexp_replace(html, '<[^>]*>', ' ', 'g')"
_CORPUS = f"""select 'page' as kind, page_id as id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, {_STRIPPED} as text, 1 as kind_order from pages
union all select 'doc', doc_id, string_split(text, chr(10))[1], text, 2 from documents union all select 'part', p_partkey, p_name, concat_ws(chr(10), p_name, p_type, p_brand), 3 from part
union all select 'talk', conv_id, role, text, 4 from conversations union all select 'item', item_id, null, text, 5 from benchmark union all select 'nation', n_nationkey, n_name, n_name, 6 from nation"""


@query("corpus_union", _CORPUS)
def corpus(t):
    """Entries of all kinds with their whole texts."""

    def entries(rows, kind, order, key, title, text):
        return rows.select(F.lit(kind).alias("kind"), F.col(key).cast("bigint").alias("id"), title.cast("string").alias("title"), text.alias("text"), F.lit(order).alias("kind_order"))

    parts = [
        entries(t.pages, "page", 1, "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.regexp_replace("html", "<[^>]*>", " ")),
        entries(t.documents, "doc", 2, "doc_id", F.get(F.split("text", "\n"), F.lit(0)), F.col("text")),
        entries(t.part, "part", 3, "p_partkey", F.col("p_name"), F.concat_ws("\n", "p_name", "p_type", "p_brand")),
        entries(t.conversations, "talk", 4, "conv_id", F.col("role"), F.col("text")),
        entries(t.benchmark, "item", 5, "item_id", F.lit(None), F.col("text")),
        entries(t.nation, "nation", 6, "n_nationkey", F.col("n_name"), F.col("n_name")),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("placement_shortlist", f"with {S.scored(_DOCS, _BENCH)}, r as ({S.ranked('s', 'true', 5)}) select query, max_by(doc, rank * -1) as best, count(*) as listed from r group by query")
def shortlist(t):
    top = R.search(_index(t), _bench(t), "item_id", "text", "any", 5)
    return top.groupBy("query").agg(F.min_by("doc", "rank").alias("best"), F.count("*").alias("listed"))


@query("grouped_hits", f"with {S.scored(_DOCS, _ONE)}, r as (select s.*, lang, row_number() over (partition by lang order by round(score, 6) desc, doc) as place from s join documents on doc = doc_id where {S.HALF}) select lang, place, doc, round(score, 6) as score from r where place <= 5")
def grouped(t):
    hits = R.search(_index(t), _one(t), "query", "text", "half", None).join(t.documents.select(F.col("doc_id").alias("doc"), "lang"), "doc")
    w = Window.partitionBy("lang").orderBy(F.desc("score"), "doc")
    return hits.withColumn("place", F.row_number().over(w)).filter("place <= 5").select("lang", "place", "doc", "score")
