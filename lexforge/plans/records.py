"""Queries of names, joins, coverage, rankings, rollups and histories over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexforge.functions import text as T
from lexforge.operators import matching as M
from lexforge.operators import ranking as K
from lexforge.operators import rollups as A
from lexforge.plans import sqltext as S
from lexforge.plans.registry import query

# ---- text scalars

query("normalize_names", f"select p_partkey, {S.normalized('p_name')} as name_key from part")(lambda t: t.part.select("p_partkey", T.normalize_name(F.col("p_name")).alias("name_key")))
query("identifier_words", r"select doc_id, list_filter(regexp_split_to_array(lower(regexp_replace(text, '([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g')), '[^\p{L}\p{N}]+'), lambda w: w <> '') as words from documents")(lambda t: t.documents.select("doc_id", T.identifier_words(F.col("text")).alias("words")))
query("statement_words", r"select doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: length(w) > 3))) as words from documents")(lambda t: t.documents.select("doc_id", F.array_sort(T.statement_words(F.col("text"))).alias("words")))
query("one_line", r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as line from documents")(lambda t: t.documents.select("doc_id", T.one_line(F.col("text")).alias("line")))
query("fold_latin", f"select doc_id, {S.folded('text')} as folded from documents")(lambda t: t.documents.select("doc_id", T.fold_latin(F.col("text")).alias("folded")))
query("content_hash", "select doc_id, sha256(text) as hash from documents")(lambda t: t.documents.select("doc_id", T.content_hash(F.col("text")).alias("hash")))
query("fingerprint", "select doc_id, sha256(lang || chr(0) || source || chr(0) || text || chr(0)) as print from documents")(lambda t: t.documents.select("doc_id", T.fingerprint(F.col("lang"), F.col("source"), F.col("text")).alias("print")))
query("query_terms", f"select conv_id, turn, {S.query_terms('text')} as terms from conversations")(lambda t: t.conversations.select("conv_id", "turn", T.query_terms(F.col("text")).alias("terms")))
query("has_content_words", f"select conv_id, turn, len({S.query_terms('text')}) > 0 as has_content from conversations")(lambda t: t.conversations.select("conv_id", "turn", T.has_content_words(F.col("text")).alias("has_content")))
query("cut_at_word", r"""select doc_id, case when length(text) <= 60 then text else regexp_replace(case when strpos(left(text, 59), ' ') > 0 then regexp_extract(left(text, 59), '(?s)^(.*) ', 1) else left(text, 59) end, '[,;: ]+$', '') || '…' end as short from documents""")(lambda t: t.documents.select("doc_id", T.cut_at_word(F.col("text"), 60).alias("short")))
query("citation_parse", r"""with c as (select p_partkey, 'src/' || p_name || '.py' || case p_partkey % 3 when 0 then '' when 1 then ':' || p_size else ':' || p_size || '-' || (p_partkey % 40) end as x from part), g as (select p_partkey, x, regexp_extract(x, ':([0-9]+)(-[0-9]+)?$', 1) as a, regexp_extract(x, ':[0-9]+-([0-9]+)$', 1) as b from c)
select p_partkey, case when a <> '' then regexp_extract(x, '^(.*):[0-9]+(-[0-9]+)?$', 1) else x end as file, case when a <> '' then least(a::int, case when b <> '' then b::int else a::int end) end as start_line, case when a <> '' then greatest(a::int, case when b <> '' then b::int else a::int end) end as end_line from g""")(
    lambda t: t.part.select("p_partkey", T.citation(F.concat(F.lit("src/"), "p_name", F.lit(".py"), F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(":"), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit(":"), F.col("p_size").cast("string"), F.lit("-"), (F.col("p_partkey") % 40).cast("string"))))).alias("c")).select("p_partkey", "c.*")
)
query("percent_share", "select n_nationkey, case when n > 0 then case when c = 0 or c >= n then (c * 100 + n // 2) // n else greatest(1, least(99, (c * 100 + n // 2) // n)) end end as share from (select c_nationkey as n_nationkey, count(*) as n, count(*) filter (where c_acctbal < 0) as c from customer group by 1)")(
    lambda t: t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(T.percent(F.count_if(F.col("c_acctbal") < 0), F.count("*")).cast("bigint").alias("share"))
)


@query("slugify_unique", f"""with s as (select p_partkey, {S.slug("split_part(p_name, ' ', 1)")} as base from part), n as (select *, row_number() over (partition by base order by p_partkey) as k from s) select p_partkey, case when k = 1 then base else base || '-' || k end as slug from n""")
def slugs(t):
    base = t.part.select("p_partkey", T.slugify(F.substring_index("p_name", " ", 1)).alias("base"))
    k = F.row_number().over(Window.partitionBy("base").orderBy("p_partkey"))
    return base.withColumn("k", k).select("p_partkey", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("k").cast("string"))).alias("slug"))


@query("name_mentions", r"""with w as (select doc_id, ' ' || array_to_string(list_transform(list_filter(regexp_split_to_array(lower(regexp_replace(text, '([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g')), '[^\p{L}\p{N}]+'), lambda x: x <> ''), lambda x: case when suffix(x, 's') and strlen(x) > 4 then x[:-2] else x end), ' ') || ' ' as ws from documents) select doc_id, contains(ws, ' of the ') as named from w""")
def name_mentions(t):
    return t.documents.select("doc_id", T.mentions(F.col("text"), F.lit("OfThe")).alias("named"))


# ---- joins and coverage

query("lookup_missing", "select o_orderkey, o_custkey, coalesce(c_name, '?') as c_name from orders left join (select * from customer where c_acctbal > 0) on o_custkey = c_custkey")(
    lambda t: M.lookup(t.orders.select("o_orderkey", "o_custkey"), t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "c_name")
)
query("coverage_unclaimed", "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey)")(
    lambda t: M.unclaimed(t.customer.select("c_custkey", "c_name"), t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
)
query("coverage_by_group", "with i as (select distinct p_brand, p_partkey from part), c as (select distinct p_brand, p_partkey from part join lineitem on l_partkey = p_partkey where l_quantity > 45), j as (select i.*, c.p_partkey as hit from i left join c using (p_brand, p_partkey)) select p_brand, count(*) as total, count(hit) as covered, list_sort(list(p_partkey) filter (where hit is null)) as uncovered from j group by p_brand having count(*) > count(hit)")(
    lambda t: M.coverage(t.part.select("p_brand", "p_partkey"), t.part.join(t.lineitem.filter("l_quantity > 45"), F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "p_partkey"), "p_brand", "p_partkey")
)
query("rule_owner_by_slug", "with r as (select p_partkey, p_brand || '-' || p_size as slug from part), o as (select p_brand as owner, min(p_partkey) as owner_pos from part group by 1) select slug, p_partkey, owner_pos, try_cast(regexp_extract(slug, '^(.+)-([0-9]+)$', 2) as bigint) as number, regexp_extract(slug, '^(.+)-([0-9]+)$', 1) as owner from r left join o on owner = regexp_extract(slug, '^(.+)-([0-9]+)$', 1)")(
    lambda t: M.by_slug_pattern(t.part.select("p_partkey", F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).alias("slug")), t.part.select(F.col("p_brand").alias("slug"), F.col("p_partkey").alias("pos")))
)


def _mentions_of_customers(t):
    return t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.upper("c_name")).when(F.col("c_custkey") % 3 == 1, F.replace("c_name", F.lit("#"), F.lit("_"))).otherwise(F.concat("c_name", F.lit("x"))).alias("mention"))


def _names(customers):
    return customers.select(F.col("c_custkey").alias("pos"), F.col("c_name").alias("name"))


query("actor_resolution", f"""with n as (select c_custkey as pos, c_name as name from customer), m as (select c_custkey as id, case c_custkey % 3 when 0 then upper(c_name) when 1 then replace(c_name, '#', '_') else c_name || 'x' end as mention from customer), l as (select lower(name) as low, min_by(name, pos) as exact from n group by 1), k as (select {S.normalized('name')} as norm, min(name) as alike from n group by 1 having count(distinct name) = 1) select id, mention, coalesce(exact, alike) as resolved from m left join l on lower(mention) = low left join k on {S.normalized('mention')} = norm""")(
    lambda t: M.resolve_names(_mentions_of_customers(t), _names(t.customer))
)


@query("path_resolution", r"""with f as (select distinct regexp_replace(url, '^https?://', '') as p from pages), c as (select distinct case page_id % 3 when 0 then './' || regexp_replace(url, '^https?://', '') when 1 then regexp_replace(regexp_replace(url, '^https?://', ''), '^[^/]*/', '') else 'x/' || regexp_replace(url, '^https?://', '') end as cited from pages), k as (select cited, regexp_replace(cited, '^(\./)+', '') as c from c), e as (select cited, p as exact from k join f on c = p), l as (select distinct cited, p from k join f on suffix(p, '/' || c) or suffix(c, '/' || p) or c = p), o as (select cited, min(p) as only from l group by 1 having count(*) = 1) select cited, coalesce(exact, o.only) as resolved from k left join e using (cited) left join o using (cited)""")
def path_resolution(t):
    path = F.regexp_replace("url", "^https?://", "")
    cited = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("./"), path)).when(F.col("page_id") % 3 == 1, F.regexp_replace(path, "^[^/]*/", "")).otherwise(F.concat(F.lit("x/"), path))
    return M.resolve_paths(t.pages.select(cited.alias("cited")), t.pages.select(path.alias("path")))


_SPANS = "select l_partkey as path, l_orderkey * 10 + l_linenumber as id, case when l_linenumber = 7 then null else date_diff('day', date '1992-01-01', l_shipdate::date) end as s, case when l_linenumber = 7 then null else date_diff('day', date '1992-01-01', l_shipdate::date) + cast(l_quantity as int) end as e, l_returnflag from lineitem"


@query("interval_overlap", f"with x as ({_SPANS}), a as (select * from x where l_returnflag = 'A'), b as (select * from x where l_returnflag = 'R') select a.path, a.id as a_id, b.id as b_id from a join b on a.path = b.path and coalesce(a.s, 0) <= coalesce(b.e, 4294967295) and coalesce(b.s, 0) <= coalesce(a.e, 4294967295)")
def interval_overlap(t):
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    x = t.lineitem.select(F.col("l_partkey").alias("path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_linenumber") != 7, day).alias("s"), F.when(F.col("l_linenumber") != 7, day + F.col("l_quantity").cast("int")).alias("e"), "l_returnflag")
    met = M.interval_overlaps(x.filter("l_returnflag = 'A'").drop("l_returnflag"), x.filter("l_returnflag = 'R'").drop("l_returnflag"), "path", "s", "e", 30)
    return met.select(F.col("a_path").alias("path"), "a_id", "b_id")


_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: length(w) > 3))"


@query("jaccard_pairs", f"with s as (select doc_id, source, {_WORDS} as w from documents), e as (select doc_id, unnest(w) as word from s), c as (select x.doc_id as a, y.doc_id as b, count(*) as n from e x join e y on x.word = y.word and x.doc_id < y.doc_id group by all) select a, b, p.source as ga, q.source as gb, round(n / (len(p.w) + len(q.w) - n), 6) as similarity from c join s p on p.doc_id = a join s q on q.doc_id = b where p.source <> q.source and n / (len(p.w) + len(q.w) - n) >= 0.6")
def jaccard_pairs(t):
    return M.similar_statements(t.documents, "doc_id", "source", "text").withColumn("similarity", F.round("similarity", 6))


query("first_claim", "select l_partkey, l_suppkey, l_orderkey from lineitem qualify row_number() over (partition by l_partkey order by l_suppkey, l_orderkey, l_linenumber) = 1")(
    lambda t: M.first_claim(t.lineitem.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber"), "l_partkey", [F.col("l_suppkey"), F.col("l_orderkey"), F.col("l_linenumber")]).drop("l_linenumber")
)
query("keep_saved_groups", "with n as (select distinct p_brand as new, p_partkey as i from part), s as (select distinct case when p_partkey % 4 = 0 then p_type else p_brand end as saved, p_partkey as i from part), b as (select new, saved, count(*) as shared from n join s using (i) group by all) select new, saved, shared, nn as new_size, ss as saved_size from b join (select new, count(*) as nn from n group by 1) using (new) join (select saved, count(*) as ss from s group by 1) using (saved) where 2 * shared > nn and 2 * shared > ss")(
    lambda t: M.keep_saved(t.part.select(F.col("p_brand").alias("name"), "p_partkey"), t.part.select(F.when(F.col("p_partkey") % 4 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("name"), "p_partkey"), "p_partkey")
)
query("shared_concepts", "with u as (select distinct l_suppkey as o, l_partkey as c from lineitem) select x.o as a, y.o as b, count(*) as shared from u x join u y on x.c = y.c and x.o < y.o group by all")(
    lambda t: M.shared_concepts(t.lineitem, "l_suppkey", "l_partkey")
)
query("stale_files", "with r as (select doc_id, sha256(text) as was from documents where doc_id % 7 <> 0), c as (select doc_id, sha256(case when doc_id % 5 = 0 then text || '!' else text end) as now from documents where doc_id % 11 <> 0) select doc_id, case when was is null then 'unknown' when now is null then 'deleted' when was = now then 'fresh' else 'modified' end as state from r full join c using (doc_id)")(
    lambda t: M.freshness(t.documents.filter("doc_id % 7 <> 0").select("doc_id", F.sha2("text", 256).alias("hash")), t.documents.filter("doc_id % 11 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash")), "doc_id")
)
query("edit_overlay", "select c_custkey, case when c_custkey % 9 = 0 then 'renamed' when c_custkey % 9 = 1 then c_name else c_name end as c_name, c_mktsegment from customer")(
    lambda t: M.overlay(t.customer.select("c_custkey", "c_name", "c_mktsegment"), t.customer.filter("c_custkey % 9 < 2").select("c_custkey", F.when(F.col("c_custkey") % 9 == 0, "renamed").otherwise(" ").alias("c_name")), "c_custkey", ["c_name"])
)
query("citations_inverse", "select l_partkey as path, count(*) as citations, count(distinct l_orderkey) as orders, count(distinct l_suppkey) as suppliers from lineitem group by 1")(
    lambda t: t.lineitem.groupBy(F.col("l_partkey").alias("path")).agg(F.count("*").alias("citations"), F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_suppkey").alias("suppliers"))
)
query("memo_reuse", "select d.doc_id, case when d.print = s.print then 'reuse' else 'ask' end as step from (select doc_id, sha256(text) as print from documents) d left join (select doc_id, sha256(case when doc_id % 6 = 0 then '' else text end) as print from documents where doc_id % 10 <> 3) s using (doc_id)")(
    lambda t: t.documents.select("doc_id", F.sha2("text", 256).alias("print")).join(t.documents.filter("doc_id % 10 <> 3").select("doc_id", F.sha2(F.when(F.col("doc_id") % 6 == 0, "").otherwise(F.col("text")), 256).alias("saved")), "doc_id", "left").select("doc_id", F.when(F.col("print") == F.col("saved"), "reuse").otherwise("ask").alias("step"))
)
query("write_plan", "with o as (select doc_id, md5(text) as h from documents where doc_id % 4 <> 1), n as (select doc_id, md5(case when doc_id % 3 = 0 then text || '.' else text end) as h from documents where doc_id % 5 <> 2) select doc_id, case when o.h is null then 'created' when n.h is null then 'removed' when o.h = n.h then 'unchanged' else 'updated' end as step from o full join n using (doc_id)")(
    lambda t: t.documents.filter("doc_id % 4 <> 1").select("doc_id", F.md5("text").alias("o")).join(t.documents.filter("doc_id % 5 <> 2").select("doc_id", F.md5(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("n")), "doc_id", "full_outer").select("doc_id", F.when(F.col("o").isNull(), "created").when(F.col("n").isNull(), "removed").when(F.col("o") == F.col("n"), "unchanged").otherwise("updated").alias("step"))
)

# ---- rankings and windows

_CHURN = "select p_partkey, p_type, p_size, count(l_orderkey) as commits, count(distinct l_suppkey) as refs from part left join lineitem on l_partkey = p_partkey group by all"


def _churn(t):
    return t.part.select("p_partkey", "p_type", "p_size").join(t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("commits"), F.count_distinct("l_suppkey").alias("refs")), "p_partkey", "left").fillna(0, ["commits", "refs"])


def _scored(t):
    return _churn(t).select("p_partkey", F.round(K.file_score(1 + F.col("p_size") % 3, F.col("commits"), F.col("refs")), 6).alias("score"))


query("file_ranking", f"with c as ({_CHURN}) select p_partkey, round((1 + p_size % 3) * (1 + ln(1 + least(commits, 65535)) + ln(1 + least(refs, 65535))), 6) as score from c")(_scored)
query("file_budget", f"with c as ({_CHURN}), s as (select p_partkey, round((1 + p_size % 3) * (1 + ln(1 + least(commits, 65535)) + ln(1 + least(refs, 65535))), 6) as score from c) select p_partkey, score, row_number() over (order by score desc, p_partkey) <= 50 as kept from s")(
    lambda t: K.budget(_scored(t), [F.desc("score"), F.col("p_partkey")], 50)
)


def _priorities(t):
    orders = t.orders.select("o_orderkey", "o_orderstatus").join(t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("e")), "o_orderkey", "left").fillna(0)
    return orders.select("o_orderkey", F.round(K.debt_priority(F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.5).otherwise(0.25), F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_orderkey") % 100) / 100.0), F.col("n"), F.col("e")), 6).alias("priority"))


query("priority_order", "with l as (select l_orderkey, count(*) as n, count(distinct l_suppkey) as e from lineitem group by 1), s as (select o_orderkey, round(case o_orderstatus when 'F' then 1.0 when 'O' then 0.5 else 0.25 end * coalesce(1 - case when o_orderkey % 5 = 0 then null else (o_orderkey % 100) / 100.0 end, 1.0) * (1 + ln(1 + coalesce(n, 0))) * (1 + ln(1 + coalesce(e, 0))), 6) as priority from orders left join l on l_orderkey = o_orderkey) select o_orderkey, priority, row_number() over (order by priority desc, o_orderkey) as rank from s")(
    lambda t: K.global_rank(_priorities(t), [F.desc("priority"), F.col("o_orderkey")])
)
query("evenly_spaced", "with e as (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as r, count(*) over (partition by user_id) as n from events) select event_id, user_id from e where (r * least(5, n)) // n <> ((r + 1) * least(5, n)) // n")(
    lambda t: K.evenly_spaced(t.events.select("event_id", "user_id", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")], 5).drop("ts")
)
query("islands", "with c as (select event_id, user_id, ts, event_type, case when lag(event_type) over w is not distinct from event_type and row_number() over w > 1 then 0 else 1 end as c from events window w as (partition by user_id order by ts, event_id)), i as (select *, sum(c) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from c) select event_id, user_id, event_type, cast(island as bigint) as island, (row_number() over (partition by user_id, island order by ts, event_id) - 1) // 5 as batch from i")(
    lambda t: K.islands(t.events.select("event_id", "user_id", "ts", "event_type"), ["user_id"], [F.col("ts"), F.col("event_id")], "event_type", 5).drop("ts")
)
query("fitting_prefix", "with s as (select p_brand, p_partkey, sum(p_size) over w as s, row_number() over w as n from part window w as (partition by p_brand order by p_partkey rows unbounded preceding)), o as (select *, max(case when s > 120 and n > 1 then 1 else 0 end) over (partition by p_brand order by p_partkey rows unbounded preceding) as over_ from s) select p_brand, p_partkey from o where over_ = 0")(
    lambda t: K.fitting_prefix(t.part.select("p_brand", "p_partkey", "p_size"), ["p_brand"], [F.col("p_partkey")], "p_size", 120).drop("p_size")
)
query("session_cap", "select conv_id, turn from (select conv_id, turn, sum(length(text)) over (partition by conv_id order by turn desc rows unbounded preceding) as s from conversations) where s <= 600")(
    lambda t: K.recent_within(t.conversations.select("conv_id", "turn", F.length("text").alias("chars")), ["conv_id"], [F.desc("turn")], "chars", 600).select("conv_id", "turn")
)
query("run_trends", "with y as (select o_orderpriority, year(o_orderdate) as run, count(*) filter (where o_orderstatus = 'F') / count(*) as share from orders group by all), s as (select *, round_even(share * 100, 0) as shown from y), l as (select *, lag(shown) over (partition by o_orderpriority order by run) as before from s) select o_orderpriority, run, shown, before, coalesce(shown < before, false) as worse from l")(
    lambda t: K.trend_flags(t.orders.groupBy("o_orderpriority", F.year("o_orderdate").alias("run")).agg((F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("share")), ["o_orderpriority"], "run", "share", True).drop("share")
)


@query("run_diff", "with r as (select o_custkey as id, year(o_orderdate) as y, round(avg(o_totalprice) / 500000, 6) as score from orders group by all), o as (select * from r where y = 1995), n as (select * from r where y = 1996) select id, o.score as old_score, n.score as new_score, case when o.id is null then 'added' when n.id is null then 'removed' when o.score - n.score >= 0.2 - 1e-6 then 'degraded' else 'same' end as state from o full join n using (id)")
def run_diff(t):
    r = t.orders.groupBy(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("y")).agg(F.round(F.avg("o_totalprice") / 500000, 6).alias("score"))
    return K.run_diff(r.filter("y = 1995"), r.filter("y = 1996"), ["id"])


query("upsert_latest", "select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1")(
    lambda t: K.latest(t.events.select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).drop("ts")
)
query("bounded_history", "select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 20")(
    lambda t: K.budget(t.events.select("user_id", "event_id", "ts"), [F.desc("ts"), F.desc("event_id")], 20, ["user_id"]).filter("kept").select("user_id", "event_id")
)
query("batch_packing", """with recursive d as (select source, n_chars as size, row_number() over (partition by source order by doc_id) as pos from documents),
b as (select source, 1::bigint as pos, size, 0::bigint as batch, size as used from d where pos = 1 union all
  select d.source, d.pos, d.size, case when used + d.size <= 12000 then batch else batch + 1 end, case when used + d.size <= 12000 then used + d.size else d.size end from b join d on d.source is not distinct from b.source and d.pos = b.pos + 1)
select source, pos::int as pos, size, batch from b""")(lambda t: K.batches(t.documents.select("source", "doc_id", "n_chars"), ["source"], [F.col("doc_id")], "n_chars", 12000))
query("number_within", "select p_brand || '-' || row_number() over (partition by p_brand order by p_partkey) as slug, p_partkey from part")(
    lambda t: t.part.select(F.concat_ws("-", "p_brand", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")).cast("string")).alias("slug"), "p_partkey")
)

# ---- rollups

query("file_history", "select event_type as path, count(*) as commits, count(distinct user_id) as authors, min(ts) as first_at, max(ts) as last_at from events group by 1")(
    lambda t: t.events.groupBy(F.col("event_type").alias("path")).agg(F.count("*").alias("commits"), F.count_distinct("user_id").alias("authors"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
)
query("count_by_key", "select lang, source, count(*) as n from documents group by all")(lambda t: t.documents.groupBy("lang", "source").agg(F.count("*").alias("n")))
query("status_pivot", "select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as f, count(*) filter (where o_orderstatus = 'O') as o, count(*) filter (where o_orderstatus = 'P') as p from orders group by 1")(
    lambda t: t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0).toDF("o_orderpriority", "f", "o", "p")
)
query("child_confidence", "with s as (select o_custkey, case when o_orderkey % 4 = 0 then null else (o_orderkey % 100) / 100.0 end as score from orders), p as (select o_custkey, avg(score) as mean, count(score) as k, count(*) as n from s group by 1) select c_custkey as o_custkey, round(case when n is null then 0.0 else mean end, 6) as confidence, coalesce(k, 0) || ' of ' || coalesce(n, 0) as rationale from customer left join p on o_custkey = c_custkey")(
    lambda t: A.child_confidence(t.customer.select(F.col("c_custkey").alias("o_custkey")), t.orders.select("o_custkey", F.when(F.col("o_orderkey") % 4 != 0, (F.col("o_orderkey") % 100) / 100.0).alias("score")), "o_custkey", "score").withColumn("confidence", F.round("confidence", 6))
)
query("usage_rollup", "select l_returnflag, l_linestatus, cast(2 - grouping(l_returnflag) - grouping(l_linestatus) as int) as level, sum(l_linenumber) as calls, sum(l_orderkey) as tokens from lineitem group by rollup (l_returnflag, l_linestatus)")(
    lambda t: A.usage_rollup(t.lineitem.select("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("bigint").alias("calls"), F.col("l_orderkey").alias("tokens")), ["l_returnflag", "l_linestatus"], ["calls", "tokens"])
)
query("latest_run", "select o_orderstatus, max(o_orderkey) as last_order, max_by(o_custkey, o_orderkey) as customer from orders group by 1")(
    lambda t: t.orders.groupBy("o_orderstatus").agg(F.max("o_orderkey").alias("last_order"), F.max_by("o_custkey", "o_orderkey").alias("customer"))
)
query("heatmap", "with n as (select o_orderpriority, o_orderstatus, count(*) as n from orders group by all), c as (select * from (select distinct o_orderpriority from orders), (values ('F'), ('O'), ('P'), ('X')) k(o_orderstatus)) select o_orderpriority, o_orderstatus, coalesce(n, 0) as n, cast(ceil(4 * coalesce(n, 0) / (select max(n) from n)) as int) as level from c left join n using (o_orderpriority, o_orderstatus)")(
    lambda t: A.heat_map(t.orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P", "X"])
)
query("ratio_spread", "with r as (select n_regionkey, n_nationkey, round(sum(o_totalprice) / nullif(sum(o_orderkey), 0), 3) as ratio from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by all) select n_regionkey, median(ratio) as median, min(ratio) as least, max(ratio) as most, count(ratio) as n from r group by 1")(
    lambda t: A.ratio_spread(t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")), ["n_regionkey"], ["n_nationkey"], "o_totalprice", "o_orderkey")
)
query("estimate_range", "with r as (select n_regionkey, n_nationkey, round(count(*) / count(distinct o_custkey), 3) as ratio from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by all) select n_regionkey, cast(floor(round(min(ratio) * 40, 6)) as bigint) as low, cast(ceil(round(max(ratio) * 40, 6)) as bigint) as high from r group by 1")(
    lambda t: t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_nationkey").agg(F.round(F.count("*") / F.count_distinct("o_custkey"), 3).alias("ratio")).groupBy("n_regionkey").agg(F.floor(F.round(F.min("ratio") * 40, 6)).alias("low"), F.ceil(F.round(F.max("ratio") * 40, 6)).alias("high"))
)
query("series_summary", "with u as (select year(o_orderdate) as s, unnest(['price', 'items']) as figure, unnest([o_totalprice, cast(o_orderkey % 7 as double)]) as value from orders), a as (select s, figure, avg(value) as mean, min(value) as least, max(value) as most, count(value) as n from u group by all) select s, figure, round(mean, 4) as mean, least, most, n, round(mean - lag(mean) over (partition by figure order by s), 4) as change from a")(
    lambda t: A.series_summary(t.orders.select(F.year("o_orderdate").alias("s"), F.col("o_totalprice").alias("price"), (F.col("o_orderkey") % 7).cast("double").alias("items")), "s", ["price", "items"]).withColumn("mean", F.round("mean", 4)).withColumn("change", F.round("change", 4))
)
query("label_confusion", "select count(quality) as labelled, count(*) filter (where quality = 1) as good, count(*) filter (where quality = 1 and n_chars < 500) as good_dropped, count(*) filter (where quality = 0) as noise, count(*) filter (where quality = 0 and n_chars < 500) as noise_dropped, count(*) filter (where quality is null) as missing from documents left join labels using (doc_id)")(
    lambda t: A.confusion(t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left"), F.col("quality") == 1, F.col("n_chars") < 500, F.col("quality").isNotNull())
)
query("recall_precision", f"with m as (select distinct p_name as made, {S.normalized('p_name')} as k from part where p_size < 30), w as (select distinct upper(p_name) as wanted, {S.normalized('upper(p_name)')} as k from part where p_size > 20), h as (select distinct made, wanted from m join w using (k)) select (select count(distinct wanted) from h) as found, (select count(distinct made) from h) as \"right\", (select count(*) from m) as made, (select count(*) from w) as wanted, (select count(distinct wanted) from h) / (select count(*) from w) as recall, (select count(distinct made) from h) / (select count(*) from m) as \"precision\"")(
    lambda t: A.recall_precision(t.part.filter("p_size < 30").select(F.col("p_name").alias("name")), t.part.filter("p_size > 20").select(F.upper("p_name").alias("name")), t.spark.createDataFrame([], "made string, wanted string"))
)
query("directory_rollup", r"""with f as (select string_split(regexp_replace(url, '^https?://', ''), '/') as p, page_id % 2 = 0 as hit from pages), d as (select array_to_string(p[1:i], '/') as directory, hit from (select p, hit, unnest(range(len(p))) as i from f)) select directory, count(*) as files, count(*) filter (where hit) as cited from d group by 1""")(
    lambda t: A.directory_rollup(t.pages.select(F.regexp_replace("url", "^https?://", "").alias("path"), (F.col("page_id") % 2 == 0).alias("hit")), "path", "hit")
)


@query("entity_merge", f"""with e as (select p_partkey as pos, p_brand as name, 'src/' || lower(p_brand) || case when p_partkey % 7 = 0 then '' else 'x' end || '.rb' as path, p_size as size, p_name as description, [p_type] as attributes from part), h as (select lower(name) as key, max_by({{'n': name, 'p': path, 'd': description}}, {{'a': cast({S.normalized(r"regexp_replace(split_part(path, '/', -1), '\.[^.]*$', '')")} = {S.normalized('name')} as int), 'b': size, 'c': length(description), 'd': -pos}}) as home, count(*) as mentions from e group by 1) select key, home.n as name, home.p as home, home.d as description, mentions from h""")
def entity_merge(t):
    e = t.part.select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("name"), F.concat(F.lit("src/"), F.lower("p_brand"), F.when(F.col("p_partkey") % 7 == 0, "").otherwise("x"), F.lit(".rb")).alias("path"), F.col("p_size").alias("size"), F.col("p_name").alias("description"), F.array("p_type").alias("attributes"))
    return A.merge_entities(e, "name", "path", "size", "description", "attributes", "pos").drop("attributes")


query("language_pick", "select max_by(lang, {'n': n, 'l': lang}) as pick from (select lang, count(*) as n from documents group by 1)")(lambda t: A.most_frequent(t.documents, "lang"))
query("ordered_union", "select 'customer' as kind, c_custkey as id, c_name as name, 1 as source_order from customer union all select 'supplier', s_suppkey, s_name, 2 from supplier")(
    lambda t: t.customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(1).alias("source_order")).unionByName(t.supplier.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(2).alias("source_order")))
)
query("dedup_first_wins", r"select conv_id, turn, text from conversations where text is not null qualify row_number() over (partition by trim(regexp_replace(lower(text), '\s+', ' ', 'g')) order by conv_id, turn) = 1")(
    lambda t: t.conversations.filter("text is not null").withColumn("n", F.row_number().over(Window.partitionBy(T.one_line(F.lower("text"))).orderBy("conv_id", "turn"))).filter("n = 1").select("conv_id", "turn", "text")
)
