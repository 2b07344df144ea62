"""Queries of evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.operators import evidence as E
from lexforge.operators import retrieval as R
from lexforge.plans import sqltext as S
from lexforge.plans.registry import query

_IDS = "select p_partkey as pos, concat('app/', p_brand, '.rb#', case p_partkey % 4 when 0 then concat('GET/POST /', replace(p_name, ' ', '/'), '/:id/open') when 1 then p_name when 2 then concat('DELETE /items/<id> ', p_brand) else ' ' end) as entry, p_type as entity from part"
_ROUTE = r"case when contains(n, ' ') and regexp_matches(string_split(n, ' ')[1], '^[A-Z]+(/[A-Z]+)*$') then array_to_string(list_filter(regexp_split_to_array(n[strpos(n, ' ') + 1:], '[/ ]'), lambda s: s <> '' and not regexp_matches(s, '^[:{<]')), ' ') else n end"
query("identifier_queries", f"with x as ({_IDS}), n as (select pos, entity, entry[strpos(entry, '#') + 1:] as n from x), q as (select pos, {_ROUTE} as route, entity from n) select pos, case when trim(route) = '' then [entity] when route = entity then [entity] else [route, entity] end as queries from q")(
    lambda t: t.sql(_IDS).select("pos", E.identifier_queries(F.array("entry"), F.array("entity", "entity")).alias("queries"))
)

_SIGNALS = "select doc_id as doc, case doc_id % 3 when 0 then 'doc' when 1 then 'test' else 'commit' end as pool, coalesce(source, '') as origin, coalesce(text, '') as text from documents"
_BENCH = "select item_id as query, text from benchmark"


def _fold(pool: str, budget: int) -> str:
    """The greedy pool by recursion over each query's ranking."""
    docs = f"select doc, origin || ' ' || text as text from ({_SIGNALS}) g where pool = '{pool}'"
    return f"""(with recursive {S.scored(docs, _BENCH)}, r as (select query, doc, least(length(g.text), 400) + 3 as cost, row_number() over (partition by query order by round(score, 6) desc, doc) as k from s join ({_SIGNALS}) g using (doc)),
f as (select query, 0::bigint as k, 0::bigint as used, []::bigint[] as docs from (select distinct query from r) union all select f.query, r.k, case when used + cost <= {budget} then used + cost else used end, case when used + cost <= {budget} then list_append(docs, r.doc) else docs end from f join r on r.query = f.query and r.k = f.k + 1)
select '{pool}' as pool, query, max(used) as used, max_by(docs, k) as docs from f group by query)"""


query("evidence_pools", " union all ".join(_fold(p, b) for p, b in E.POOLS.items()))(
    lambda t: E.evidence_pools(t.sql(_SIGNALS), t.benchmark.select("item_id", "text"), "item_id", "text")
)

_SECTIONS = "select conv_id, string_agg(coalesce(text, ''), chr(10) || chr(10) order by turn) as body from conversations group by 1"


@query("paragraphs", r"""with l as (select conv_id, turn, unnest(string_split(coalesce(text, '') || chr(10) || chr(10), chr(10))) as x, generate_subscripts(string_split(coalesce(text, '') || chr(10) || chr(10), chr(10)), 1) as n from conversations),
b as (select *, count(*) filter (where trim(x) = '') over (partition by conv_id order by turn, n) as part from l)
select conv_id, list(p order by part) as paragraphs from (select conv_id, part, string_agg(x, chr(10) order by turn, n) as p from b where trim(x) <> '' group by 1, 2) group by 1""")
def paragraphs(t):
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n\n")
    out = t.conversations.groupBy("conv_id").agg(text.alias("body")).select("conv_id", E.paragraphs(F.col("body")).alias("paragraphs"))
    return out.filter(F.size("paragraphs") > 0)


_RANKED = "select conv_id as section, cast(turn as int) as paragraph, length(coalesce(text, '')) as chars, q as query_no, row_number() over (partition by conv_id, q order by (turn * 7 + q * 3) % 11, turn) as rank from conversations cross join (select 0 as q union all select 1 union all select 2) z"


@query("paragraph_choice", f"""with recursive r as ({_RANKED}),
f as (select section, 0 as turn, 900::bigint as room, []::int[] as taken from (select distinct section from r) union all
  select f.section, turn + 1, case when b.paragraph is null then room else room - b.chars - 20 end, case when b.paragraph is null then taken else list_append(taken, b.paragraph) end
  from f left join lateral (select paragraph, chars from r where r.section = f.section and r.query_no = f.turn % 3 and not list_contains(f.taken, r.paragraph) and r.chars + 20 <= f.room order by rank limit 1) b on true where turn < 138)
select section, unnest(taken) as paragraph from f where turn = 138""")
def paragraph_choice(t):
    return E.paragraph_choice(t.sql(_RANKED), "section", 900, 20)


query("covering_statements", f"with {S.scored('select doc_id as doc, text from documents', _BENCH)}, u as (select coalesce(text, '') as t, min(doc_id) as doc from documents group by 1), h as (select query, doc, row_number() over (partition by query order by round(score, 6) desc, doc) as place from s where doc in (select doc from u)) select * from h where place <= 4")(
    lambda t: E.covering_statements(t.documents.select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text")), t.benchmark, "item_id", "text", 4)
)
