"""Queries of the deterministic parts of analysis passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import passes as P
from lexforge.operators import ranking as K
from lexforge.plans.registry import query
from lexforge.sources import files as S

query("placement", "with c as (select l_partkey as item, l_suppkey as holder, l_orderkey * 10 + l_linenumber as pos from lineitem where l_quantity > 49), f as (select item, min_by(holder, pos) as holder from c group by 1) select p_partkey as item, coalesce('s' || holder, 'uncategorized') as holder from part left join f on item = p_partkey")(
    lambda t: P.place(t.part.select(F.col("p_partkey").alias("item")), t.lineitem.filter("l_quantity > 49").select(F.col("l_partkey").alias("item"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("holder"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos")), "item", "holder", "pos")
)
query("route_owner", "with w as (select p_partkey as id, list_reverse(string_split(p_name, ' ')) as ws from part), o as (select word, count(distinct owner) as k, min(owner) as owner from (select unnest(string_split(p_name, ' ')) as word, p_brand as owner from part) group by 1), x as (select id, unnest(ws) as word, generate_subscripts(ws, 1) as n from w), f as (select id, min_by({'k': k, 'o': owner}, n) as x from x join o using (word) group by 1) select p_partkey as id, case when x.k = 1 then x.o end as owner from part left join f on id = p_partkey")(
    lambda t: P.owner_by_route(t.part.select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("words")), t.part.select(F.explode(F.split("p_name", " ")).alias("word"), F.col("p_brand").alias("owner")), "id", "words").select("id", "owner")
)
query("context_of_files", "with f as (select distinct regexp_replace(url, '^https?://', '') as path from pages), u as (select path, unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) as folder from f), d as (select distinct array_to_string(string_split(path, '/')[1:2], '/') as folder, string_split(path, '/')[2] as context from f), n as (select path, max_by(context, length(folder)) as c from u join d using (folder) group by 1) select path, case when length(path) % 7 = 0 then 'listed' else coalesce(c, 'support') end as context from f left join n using (path)")(
    lambda t: (lambda f: P.resolve_context(f, f.filter(F.length("path") % 7 == 0).select("path", F.lit("listed").alias("context")), f.select(F.array_join(F.slice(F.split("path", "/"), 1, 2), "/").alias("folder"), F.get(F.split("path", "/"), F.lit(1)).alias("context")).distinct()))(t.pages.select(F.regexp_replace("url", "^https?://", "").alias("path")).distinct())
)
# A third of the files declare nothing but routes of others.
_ROUTES = "select distinct l_suppkey as file, case when l_suppkey % 3 = 0 or l_linenumber = 1 then cast(l_partkey as string) else concat(cast(l_partkey as string), '-', cast(l_suppkey as string)) end as route from lineitem"


@query("routes_declared_elsewhere", f"""with r as ({_ROUTES}), o as (select r.file, g.file as g, r.route from r join r g on g.route = r.route and g.file <> r.file), per as (select file, count(*) as n from r group by 1),
c as (select file, count(distinct route) as covered, count(distinct g) as files from o group by 1), x as (select file from per join c using (file) where covered >= 0.5 * n and files >= 3)
select file, route from r where not exists (select 1 from o where o.file = r.file and o.route = r.route and o.file in (select file from x))""")
def routes_declared_elsewhere(t):
    routes = t.sql(_ROUTES).withColumn("segments", F.array("route"))
    return P.routes_declared_elsewhere(routes).select("file", "route")


query("grounded_steps", "with s as (select l_orderkey, l_linenumber, l_partkey, case when l_linenumber % 5 = 0 then ' ' else 'do ' || l_linenumber end as action from lineitem), k as (select * from s where trim(action) <> '') select l_orderkey, l_linenumber, action, count(*) filter (where p_partkey is not null) as refs, cast(row_number() over (partition by l_orderkey order by l_linenumber) as int) as n from k left join (select p_partkey from part where p_size < 25) on p_partkey = l_partkey group by l_orderkey, l_linenumber, action")(
    lambda t: P.grounded_steps(t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 5 == 0, " ").otherwise(F.concat(F.lit("do "), F.col("l_linenumber").cast("string"))).alias("action"), F.array(F.struct(F.col("l_partkey").alias("path"))).alias("refs")), t.part.filter("p_size < 25").select(F.col("p_partkey").alias("path")), "l_orderkey", "l_linenumber")
)
query("grounded_rules", "with r as (select p_partkey as pos, case p_size % 4 when 0 then 'guess' when 1 then 'validation' else 'permission' end as kind, p_name as statement, p_brand as path, p_size as s, p_size + p_partkey % 30 as e from part), l as (select p_brand as path, count(*) / 2 as n from part group by 1), k as (select r.* from r join l using (path) where kind in ('validation', 'permission') and s >= 1 and e <= n and s <= e) select pos, kind, statement from k qualify row_number() over (partition by trim(regexp_replace(lower(statement), '\\s+', ' ', 'g')) order by pos) = 1")(
    lambda t: P.grounded_rules(t.part.select(F.col("p_partkey").alias("pos"), F.when(F.col("p_size") % 4 == 0, "guess").when(F.col("p_size") % 4 == 1, "validation").otherwise("permission").alias("kind"), F.col("p_name").alias("statement"), F.col("p_brand").alias("path"), F.col("p_size").alias("start"), (F.col("p_size") + F.col("p_partkey") % 30).alias("end")), t.part.groupBy(F.col("p_brand").alias("path")).agg((F.count("*") / 2).alias("n_lines")), ["validation", "permission"]).select("pos", "kind", "statement")
)
query("combined_confidence", "with s as (select l_orderkey, (list_value('pass', 'ungrounded', 'doubtful', 'broken'))[l_linenumber % 4 + 1] as k, case l_partkey % 4 when 0 then 'yes' when 1 then 'partly' when 2 then 'no' end as v from lineitem) select l_orderkey, round(avg(case k when 'pass' then 1.0 when 'ungrounded' then 0.25 when 'broken' then 0.0 else case v when 'yes' then 1.0 when 'partly' then 0.5 when 'no' then 0.0 end end), 6) as confidence, count(*) as steps from s group by 1")(
    lambda t: P.combined_confidence(t.lineitem.select("l_orderkey", F.element_at(F.array(*[F.lit(c) for c in ("pass", "ungrounded", "doubtful", "broken")]), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("k"), F.when(F.col("l_partkey") % 4 == 0, "yes").when(F.col("l_partkey") % 4 == 1, "partly").when(F.col("l_partkey") % 4 == 2, "no").alias("v")), "l_orderkey", "k", "v").withColumn("confidence", F.round("confidence", 6))
)
query("estimate_miss", "select p_partkey, case when p_size % 11 = 0 then 'lower bound' when p_size * 3 > 100 then 'over by ' || cast(floor((p_size * 3 - 100) * 100 / 100) as int) || '%' when p_size * 3 < 20 then 'under by ' || cast(floor((20 - p_size * 3) * 100 / 20) as int) || '%' else 'within' end as miss from part")(
    lambda t: t.part.select("p_partkey", P.estimate_miss(F.lit(20), F.lit(100), F.col("p_size") * 3, F.col("p_size") % 11 != 0).alias("miss"))
)
query("sequence_diagrams", "with s as (select conv_id, turn, role, lead(role) over (partition by conv_id order by turn) as nxt from conversations), h as (select conv_id, list(role order by turn) as rs, string_agg(role || '->>' || coalesce(nxt, role) || ': turn ' || turn, chr(10) order by turn) as arrows from s group by 1) select conv_id, 'sequenceDiagram' || chr(10) || array_to_string(list_transform(list_transform(list_sort(list_transform(list_distinct(rs), lambda y: {'p': list_position(rs, y), 'v': y})), lambda z: z.v), lambda a: 'participant ' || a), chr(10)) || chr(10) || arrows as diagram from h")(
    lambda t: P.sequence_diagram(t.conversations.select("conv_id", "turn", "role", F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("action")), "conv_id", "turn", "role", "action")
)
query("mechanical_groups")(lambda t: P.mechanical_groups(t.pages.select(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("path")).distinct(), t.pages.select(F.array_join(T.file_name_words(F.regexp_extract("url", r"//([^./]+)\.", 1)), " ").alias("name"))))
query("merge_small_groups", "with g as (select p_partkey as item, case when p_partkey % 17 = 0 then 'g' || p_partkey else p_type end as grp, p_brand as folder from part), k as (select grp, count(*) as k from g group by 1), b as (select folder, grp, count(*) as n from g where grp in (select grp from k where k > 1) group by all), t as (select folder, grp as to_ from b qualify row_number() over (partition by folder order by n desc, grp) = 1) select item, folder, case when k = 1 and to_ is not null then to_ else grp end as grp from g join k using (grp) left join t using (folder)")(
    lambda t: P.merge_small(t.part.select(F.col("p_partkey").alias("item"), F.when(F.col("p_partkey") % 17 == 0, F.concat(F.lit("g"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_type")).alias("grp"), F.col("p_brand").alias("folder")), "item", "grp", "folder")
)
query("saved_order", "with r as (select n_nationkey, n_nationkey as pos, case when n_nationkey % 3 = 0 then null else 100 - n_nationkey end as old from nation), s as (select pos as slot, row_number() over (order by pos) as k from r where old is not null), o as (select n_nationkey, row_number() over (order by old, pos) as k from r where old is not null) select n_nationkey, coalesce(slot, pos) as place from r left join (select n_nationkey, slot from o join s using (k)) using (n_nationkey)")(
    lambda t: K.saved_order(t.nation.select("n_nationkey", F.col("n_nationkey").alias("pos"), F.when(F.col("n_nationkey") % 3 != 0, 100 - F.col("n_nationkey")).alias("old")), "n_nationkey", "pos", "old").select("n_nationkey", "place")
)
query("gherkin_titles", "select p_partkey, ['Feature: ' || p_name, 'Scenario: ' || p_type] as titles from part")(
    lambda t: t.part.select("p_partkey", S.gherkin_titles(F.concat(F.lit("Feature: "), "p_name", F.lit("\n  As a user\n  Scenario: "), "p_type", F.lit("\n    Given x"))).alias("titles"))
)
query("code_definitions", "select p_partkey, 2 as line, 'def' as kind, replace(p_name, ' ', '_') as name, 'def ' || replace(p_name, ' ', '_') || '(self):' as signature from part")(
    lambda t: S.definitions(t.part.select("p_partkey", F.concat(F.lit("# defines\n  def "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("(self):\n    pass")).alias("c")), "p_partkey", "c")
)
query("merged_maps", "select c_custkey as key, coalesce(md5(s_name), md5(c_name)) as hash from customer left join supplier on s_suppkey = c_custkey")(
    lambda t: t.customer.select(F.col("c_custkey").alias("key"), F.md5("c_name").alias("hash"), F.lit(0).alias("o")).unionByName(t.supplier.select(F.col("s_suppkey").alias("key"), F.md5("s_name").alias("hash"), F.lit(1).alias("o"))).groupBy("key").agg(F.max_by("hash", "o").alias("hash"))
)
