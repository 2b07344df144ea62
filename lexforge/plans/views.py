"""Queries of record views, budgets and structured sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import documents as D
from lexforge.operators import ranking as K
from lexforge.plans import sqltext as S
from lexforge.plans.registry import ORACLE_SQL, query

query("class_names", r"with p as (select p_partkey, 'src/' || case p_partkey % 3 when 0 then 'index' else replace(p_name, ' ', '_') end || '.py' as path from part) select p_partkey, case when lower(s) not in ('index', 'mod', 'main', 'init', 'url', 'urls', 'route', 'view', 'handler') then array_to_string(list_transform(regexp_split_to_array(s, '[_-]'), lambda w: upper(left(w, 1)) || substring(w, 2)), '') end as class from (select p_partkey, regexp_replace(string_split(path, '/')[-1], '\..*$', '') as s from p)")(
    lambda t: t.part.select("p_partkey", D.class_name(F.concat(F.lit("src/"), F.when(F.col("p_partkey") % 3 == 0, "index").otherwise(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit(".py"))).alias("class"))
)
query("heading_anchors", r"select page_id, replace(regexp_replace(lower(trim(regexp_extract(html, '<title>([^<]*)</title>', 1))), '[^\p{L}\p{N} _-]', '', 'g'), ' ', '-') as anchor from pages")(
    lambda t: t.pages.select("page_id", D.heading_anchor(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("anchor"))
)

def _answer():
    """The events' objects, fenced, or bare among prose and other objects."""
    fenced = F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\nDone {x}."))
    return F.when(F.col("event_id") % 3 == 0, fenced).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here: "), "props", F.lit(' and {"k": 99} too.'))).otherwise(F.concat("props", F.lit(" }")))


query("json_answers", "select event_id, json_extract_string(props, '$.k')::int as k from events")(
    lambda t: t.events.select("event_id", F.get_json_object(D.json_answer(_answer()), "$.k").cast("int").alias("k"))
)
query("part_markers", "select doc_id, text as plain from documents")(lambda t: t.documents.select("doc_id", D.without_part_marker(D.part_marker(F.lit(2), F.lit(3), F.col("text"))).alias("plain")))
query("line_window", r"select doc_id, list_transform(string_split(text, chr(10))[2:4], lambda x: left(x, 400)) as lines from documents")(lambda t: t.documents.select("doc_id", D.line_window(F.col("text"), 2, 4).alias("lines")))
query("chunks")(lambda t: D.chunks(t.documents, "doc_id", "text", 1000, 1_000_000))
query("static_segments", r"with s as (select page_id, list_filter(string_split(regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[?#].*$', ''), '/'), lambda x: x <> '') as p from pages) select page_id, list_filter(list_transform(p, lambda x, i: case when regexp_matches(x, '^[:{<*]') then '*' when i = len(p) then string_split(x, '.')[1] else x end), lambda x: x <> '*' and not regexp_matches(x, '^v[0-9]+$')) as segments from s")(
    lambda t: t.pages.select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*", ""), "[?#].*$", "").alias("p")).select("page_id", D.static_segments(F.col("p")).alias("segments"))
)
query("catalog_texts", "select event_id, 'k' as key, json_extract_string(props, '$.k') as text from events")(lambda t: D.flat_catalog(t.events.select("event_id", "props"), "event_id", "props"))
query("manifests", "select p_partkey, p_name as name, p_type as description, [p_brand] as dependencies from part")(
    lambda t: D.manifest(t.part.select("p_partkey", F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.create_map("p_brand", F.lit("1")).alias("dependencies"))).alias("c")), "p_partkey", "c")
)


_COMMITS = "select l_partkey as path, l_orderkey * 10 + l_linenumber as seq, max(case when l_suppkey % 7 = 0 then l_partkey + 1 end) as renamed_from from lineitem group by 1, 2"


@query("renamed_log", f"""with recursive c as ({_COMMITS}), born as (select path, seq, renamed_from from c where renamed_from is not null),
h as (select path as start, path, null::bigint as before, 0 as hop from (select distinct path from c) union all
  select h.start, b.renamed_from, b.seq, hop + 1 from h join lateral (select seq, renamed_from from born where born.path = h.path and (h.before is null or born.seq < h.before) order by seq desc limit 1) b on true where hop < 7),
n as (select h.start, c.seq from h join c on c.path = h.path and (h.before is null or c.seq < h.before) where c.seq >= coalesce((select max(seq) from born where born.path = h.path and (h.before is null or born.seq < h.before)), 0))
select start, seq, row_number() over (partition by start order by seq desc) as place from n qualify place <= 5""")
def renamed_log(t):
    commits = t.sql(_COMMITS)
    return D.renamed_log(commits, commits.select(F.col("path").alias("start")).distinct(), 5).select("start", "seq", "place")


_SRC = "select doc_id, 'src/' || regexp_extract(text, '^[^a-zA-Z]*([a-zA-Z]+)', 1) || '.py' as path, doc_id as k, text from documents"


@query("name_mention_counts", rf"""with f as (select path, min_by(text, k) as text from ({_SRC}) group by 1), o as (select path as owner, {S.normalized(r"regexp_replace(string_split(path, '/')[-1], '\.[^.]*$', '')")} as key from f), w as (select owner, key from o where key in (select key from o group by 1 having count(*) <= 3)), s as (select path as src, unnest(list_distinct(list_transform(list_filter(regexp_split_to_array(text, '[^\p{{L}}\p{{N}}_]+'), lambda x: strlen(x) >= 4), lambda x: {S.normalized('x')}))) as key from f), h as (select owner as path, count(*) as refs from s join w using (key) where src <> owner group by 1) select path, coalesce(refs, 0) as refs from f left join h using (path)""")
def name_mention_counts(t):
    d = t.documents.select("doc_id", F.concat(F.lit("src/"), F.regexp_extract("text", "^[^a-zA-Z]*([a-zA-Z]+)", 1), F.lit(".py")).alias("path"), "text")
    return D.name_mentions(d.groupBy("path").agg(F.min_by("text", "doc_id").alias("text")), "path", "text")


query("surface_resources", "with e as (select p_partkey as pos, lower(p_brand) as resource, p_type as file, unnest(regexp_split_to_array(p_container, '\\s*,\\s*')) as v, generate_subscripts(regexp_split_to_array(p_container, '\\s*,\\s*'), 1) as n from (select *, split_part(p_type, ' ', 1) || ', ' || split_part(p_name, ' ', 1) as p_container from part)) select resource, count(distinct pos) as entries, list_sort(list(distinct file)) as files, list_transform(list_sort(list_transform(list_distinct(list(v)), lambda y: {'p': list_position(list(v order by pos, n), y), 'v': y})), lambda z: z.v) as verbs from e group by 1")(
    lambda t: D.surface_resources(t.part.select("p_partkey", "p_brand", "p_type", F.concat(F.substring_index("p_type", " ", 1), F.lit(", "), F.substring_index("p_name", " ", 1)).alias("verb")), "p_brand", "verb", "p_type", "p_partkey")
)
query("outdated_work", "with w as (select c_custkey as id, md5(c_name) as print from customer where c_custkey % 2 = 0), s as (select c_custkey as id, md5(case when c_custkey % 10 = 0 then c_name || '.' else c_name end) as print from customer), r as (select o_custkey as id, o_orderkey as path, md5(o_orderstatus) as hash from orders), c as (select o_orderkey as path, md5(case when o_orderkey % 50 = 0 then 'x' else o_orderstatus end) as hash from orders where o_orderkey % 97 <> 0), q as (select o_custkey as id, o_orderkey as path from orders where o_orderkey % 3 <> 0), m as (select distinct r.id from r join q using (id, path) left join c on c.path = r.path where r.hash is distinct from c.hash) select w.id, (w.print is distinct from s.print) or m.id is not null as outdated from w left join s using (id) left join m on m.id = w.id")(
    lambda t: D.outdated(
        t.customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.md5("c_name").alias("print")),
        t.customer.select(F.col("c_custkey").alias("id"), F.md5(F.when(F.col("c_custkey") % 10 == 0, F.concat("c_name", F.lit("."))).otherwise(F.col("c_name"))).alias("print")),
        t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("path"), F.md5("o_orderstatus").alias("hash")),
        t.orders.filter("o_orderkey % 97 <> 0").select(F.col("o_orderkey").alias("path"), F.md5(F.when(F.col("o_orderkey") % 50 == 0, "x").otherwise(F.col("o_orderstatus"))).alias("hash")),
        t.orders.filter("o_orderkey % 3 <> 0").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("path")),
    )
)
query("actor_matrix", "with a as (select l_suppkey as actor, l_returnflag as feature, 1 as p from lineitem union all select l_suppkey, l_returnflag, 2 from lineitem where l_linenumber = 1 and l_quantity > 40) select actor, feature, case when max(p) = 2 then 'starts' else 'takes part' end as part from a group by all")(
    lambda t: D.actor_matrix(t.lineitem.select(F.col("l_suppkey").alias("actor"), F.col("l_returnflag").alias("feature")), t.lineitem.filter("l_linenumber = 1 and l_quantity > 40").select(F.col("l_suppkey").alias("actor"), F.col("l_returnflag").alias("feature")))
)
query("review_progress", "with s as (select c_mktsegment as kind, c_custkey as id from customer), r as (select c_mktsegment as kind, c_custkey as id, case c_custkey % 4 when 0 then 'validated' when 1 then 'wrong' else 'to_review' end as status, c_custkey % 5 = 0 as outdated from customer where c_custkey % 3 = 0) select kind, count(*) as sections, count(*) filter (where status = 'validated') as validated, count(*) filter (where status = 'wrong') as wrong, count(*) filter (where status = 'to_review') as to_review, count(*) filter (where outdated) as outdated from s left join r using (kind, id) group by 1")(
    lambda t: D.review_progress(t.customer.select(F.col("c_mktsegment").alias("kind"), F.col("c_custkey").alias("id")), t.customer.filter("c_custkey % 3 = 0").select(F.col("c_mktsegment").alias("kind"), F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 == 0, "validated").when(F.col("c_custkey") % 4 == 1, "wrong").otherwise("to_review").alias("status"), (F.col("c_custkey") % 5 == 0).alias("outdated")))
)
query("majority_owner", "with m as (select l_partkey as key, l_suppkey as file, l_linenumber as n from lineitem), n as (select key, s_nationkey as owner, sum(n) as n from m join supplier on s_suppkey = file group by all) select key, owner, n from n where n > 0 qualify row_number() over (partition by key order by n desc, owner) = 1")(
    lambda t: D.majority_owner(t.lineitem.select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("file"), F.col("l_linenumber").cast("bigint").alias("n")), t.supplier.select(F.col("s_suppkey").alias("file"), F.col("s_nationkey").alias("owner"), F.col("s_nationkey").alias("owner_pos")))
)
_CHECKS = ["pass", "ungrounded", "doubtful", "broken"]
query("step_tally", "with s as (select l_returnflag, (list_value('pass', 'ungrounded', 'doubtful', 'broken'))[l_linenumber % 4 + 1] as c from lineitem) select l_returnflag, count(*) filter (where c = 'pass') as pass, count(*) filter (where c = 'ungrounded') as ungrounded, count(*) filter (where c = 'doubtful') as doubtful, count(*) filter (where c = 'broken') as broken from s group by 1")(
    lambda t: D.step_tally(t.lineitem.select("l_returnflag", F.element_at(F.array(*[F.lit(c) for c in _CHECKS]), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("c")), "l_returnflag", "c")
)
query("pattern_coverage", "with l as (select lang, unnest(string_split(text, chr(10))) as line from documents), g as (select lang, avg(case when starts_with(line, 'Th') then regexp_matches(line, '^Th.*and')::int end) as coverage, avg(regexp_matches(line, '^Th.*and')::int) as breadth from l group by 1) select lang, round(case when breadth <= 0.5 then coverage end, 6) as coverage, round(breadth, 6) as breadth from g")(
    lambda t: D.pattern_coverage(t.documents.select("lang", F.explode(F.split("text", "\n")).alias("line")).withColumn("e", F.col("line").startswith("Th")), "lang", "line", "e", "^Th.*and").select("lang", F.round("coverage", 6).alias("coverage"), F.round("breadth", 6).alias("breadth"))
)
query("even_shares", """with recursive p as (select p_brand, p_partkey, p_size, row_number() over (partition by p_brand order by p_size, p_partkey) as k, count(*) over (partition by p_brand) as n from part),
s as (select p_brand, p_partkey, k, n, least(p_size, 500 // n)::bigint as share, 500 - least(p_size, 500 // n)::bigint as room from p where k = 1 union all
  select p.p_brand, p.p_partkey, p.k, p.n, least(p.p_size, room // (p.n - s.k))::bigint, room - least(p.p_size, room // (p.n - s.k))::bigint from s join p on p.p_brand = s.p_brand and p.k = s.k + 1)
select p_brand, p_partkey, share from s""")(lambda t: D.even_shares(t.part.select("p_brand", "p_partkey", "p_size"), "p_brand", "p_partkey", "p_size", 500))


def _undocumented(t):
    return t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, (F.col("o_orderkey") % 100) / 100.0).alias("c")).join(t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n")), "o_orderkey", "left").fillna(0, ["n"])


query("undocumented_order", "select o_orderkey, row_number() over (order by n desc, c desc nulls last, o_orderkey) as place from (select o_orderkey, count(l_linenumber) as n, case when o_orderkey % 4 = 0 then null else (o_orderkey % 100) / 100.0 end as c from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey)")(
    lambda t: K.global_rank(_undocumented(t), [F.desc("n"), F.desc_nulls_last("c"), F.col("o_orderkey")], "place").select("o_orderkey", "place")
)
query("featureless_parents", "select n_nationkey from nation where n_nationkey not in (select s_nationkey from supplier where s_acctbal > 5000)")(
    lambda t: t.nation.select("n_nationkey").join(t.supplier.filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey")), "n_nationkey", "left_anti")
)
query("run_metrics", "select count(*) as sections, avg(case when quality = 1 then 1.0 else 0.0 end) as good_share, count(distinct lang) as kinds from documents left join labels using (doc_id)")(
    lambda t: t.documents.join(t.labels, "doc_id", "left").agg(F.count("*").alias("sections"), F.avg(F.when(F.col("quality") == 1, 1.0).otherwise(0.0)).alias("good_share"), F.count_distinct("lang").alias("kinds"))
)
query("start_counts", "select 'documents' as what, count(*) as n from documents union all select 'pages', count(*) from pages union all select 'parts', count(*) from part")(
    lambda t: t.documents.agg(F.lit("documents").alias("what"), F.count("*").alias("n")).unionByName(t.pages.agg(F.lit("pages").alias("what"), F.count("*").alias("n"))).unionByName(t.part.agg(F.lit("parts").alias("what"), F.count("*").alias("n")))
)
query("low_confidence_sources", "select doc_id, n_chars from documents join labels using (doc_id) where quality = 0")(lambda t: t.documents.join(t.labels.filter("quality = 0").select("doc_id"), "doc_id").select("doc_id", "n_chars"))
query("thousands", "select o_orderkey, format('{:,}', o_orderkey * 1000) as shown from orders")(lambda t: t.orders.select("o_orderkey", T.thousands(F.col("o_orderkey") * 1000).alias("shown")))
