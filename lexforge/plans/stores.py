"""Queries of kept state, pages, views by key and shells of passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.operators import stores as K
from lexforge.plans import model
from lexforge.plans.registry import query

_WITH = f"with domains as ({model.DOMAINS}), features as ({model.FEATURES}), use_cases as ({model.USE_CASES}), files as ({model.FILES}), lines as ({model.LINES})"

query("kept_when_unread", "select c_custkey as key, case when c_custkey % 3 = 0 then 'new' else 'saved' end as origin from customer where c_custkey % 3 = 0 or c_custkey % 2 = 0")(
    lambda t: K.incoming(t.customer.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("key"), F.lit("new").alias("origin")), t.customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.lit("saved").alias("origin")), "key")
)
_PARTS = f"select distinct path as file, part % 20 as part from ({model.LINES}) l"
query("read_state", f"with p as ({_PARTS}) select file, count(*) as parts, count(*) filter (where (part * 7 + length(file)) % 100 < 95) as answered, count(*) = count(*) filter (where (part * 7 + length(file)) % 100 < 95) as \"read\" from p group by 1")(
    lambda t: K.read_state(t.sql(_PARTS), t.sql(_PARTS).filter("(part * 7 + length(file)) % 100 < 95"))
)
query("results_in_order", f"{_WITH} select f.slug, upper(f.slug) as answer, pos from features f where pos % 6 > 0")(
    lambda t: K.in_order(t.sql(model.FEATURES).filter("pos % 6 > 0").select("slug", F.upper("slug").alias("answer")), t.sql(model.FEATURES), "slug", "pos")
)
_EDITS = "select concat('feature-', cast(l_partkey as string)) as slug, l_orderkey * 10 + l_linenumber as version, case when l_suppkey % 3 = 0 then ' ' else concat('edit ', cast(l_orderkey as string)) end as text from lineitem where l_partkey % 2 = 0 and l_linenumber = 1"
query("live_model", f"{_WITH}, e as (select slug, max_by(text, version) as t from ({_EDITS}) x group by 1) select slug, case when trim(t) <> '' then t else name end as text, coalesce(trim(t) <> '', false) as edited from features left join e using (slug)")(
    lambda t: K.live_model(t.sql(model.FEATURES).select("slug", F.col("name").alias("text")), t.sql(_EDITS).groupBy("slug", "version").agg(F.max("text").alias("text")), "slug", "version")
)
_PAGED = f"select pos, slug, name, case when pos % 2 = 0 then null else concat('About ', name) end as description from ({model.DOMAINS}) d"


@query("domain_pages", f"""{_WITH}, p as ({_PAGED}), l as (select domain as slug, string_agg('- [' || name || '](' || slug || '.md)', chr(10) order by pos) as body from features group by 1)
select slug || '.md' as path, '# ' || name || coalesce(chr(10) || chr(10) || description, '') || coalesce(chr(10) || chr(10) || body, '') as text from p left join l using (slug)
union all select 'index.md', '# Domains' || chr(10) || chr(10) || string_agg('- [' || name || '](' || slug || '.md)', chr(10) order by pos) from p""")
def domain_pages(t):
    return K.domain_pages(t.sql(_PAGED), t.sql(model.FEATURES))


_ASKED = "select concat('d', cast(r_regionkey * 9 as string)) as slug from region"
query("record_view", f"{_WITH}, a as ({_ASKED}), c as (select domain, list(slug order by pos) as xs from features group by 1), k as (select list(slug order by pos) as xs from domains) select a.slug as asked, case when d.slug is not null then 'domain' end as found, name, case when d.slug is not null then coalesce(c.xs, []) end as children, case when d.slug is null then k.xs end as known from a left join domains d using (slug) left join c on c.domain = a.slug, k")(
    lambda t: K.record_view(t.sql(model.DOMAINS), t.sql(_ASKED), t.sql(model.FEATURES).select(F.col("domain").alias("parent"), F.col("slug").alias("child"), "pos"))
)
query("suggestions", "select cast(0 as int) as place, 'What is it for?' as question union all select cast(n_nationkey + 1 as int), 'What does ' || n_name || ' do?' from nation where n_nationkey < 3")(lambda t: K.suggestions(t.sql(model.DOMAINS), "What is it for?"))

_EVIDENCE = f"select pos as id, case when pos % 12 = 0 then concat('gone/', path) else path end as path, case when part % 4 = 0 then null else concat('H', cast(part % 9 as string)) end as heading from ({model.LINES}) l where nth = 1"
_HEADINGS = f"select path, concat('H', cast(h.h as string)) as heading from ({model.FILES}) f cross join (select 1 as h union all select 2 union all select 3) h"
query("evidence_problems", f"{_WITH}, e as ({_EVIDENCE}), h as ({_HEADINGS}) select id, 'no file' as problem from e where path not in (select path from files) union all select id, 'no heading' from e where path in (select path from files) and heading is not null and not exists (select 1 from h where h.path = e.path and h.heading = e.heading)")(
    lambda t: K.evidence_problems(t.sql(_EVIDENCE), t.sql(model.FILES), t.sql(_HEADINGS))
)
_ASKS = "select c_custkey as id, case when c_custkey % 4 = 0 then null else concat('feature-', cast(c_custkey * 2 as string)) end as feature, concat('Word', cast(c_custkey % 30 as string)) as absent from customer"
query("question_problems", f"{_WITH}, q as ({_ASKS}) select id, 'no feature' as problem from q where feature is not null and feature not in (select slug from features) union all select id, 'term is there' from q where lower(absent) in (select 'word' || s_suppkey % 12 from supplier)")(
    lambda t: K.question_problems(t.sql(_ASKS).withColumn("absent", F.array("absent")), t.sql(model.FEATURES).select(F.col("slug").alias("feature")), t.sql("select concat('word', cast(s_suppkey % 12 as string)) as word from supplier"))
)

_CLAIMS = "select l_orderkey as claim, l_linenumber as nth, concat('S', cast(l_suppkey * 2 as string)) as id from lineitem"
_SIGNAL = "select concat('S', cast(s_suppkey as string)) as id, concat('doc', cast(s_nationkey as string)) as origin from supplier"
query("resolved_claims", f"with m as (select claim, origin, min(nth) as nth from ({_CLAIMS}) c join ({_SIGNAL}) s using (id) group by 1, 2) select claim, list(origin order by nth, origin) as origins from m group by 1")(
    lambda t: K.resolved_claims(t.sql(_CLAIMS), t.sql(_SIGNAL))
)
_ANSWERS = f"select part, concat('N', cast(supplier % 12 as string)) as name, pos from ({model.LINES}) l"
_BATCH = "select p_partkey as part, p_brand as file from part where p_partkey % 3 > 0"
query("attributed_answers", f"select file, name, min(pos) as pos from ({_ANSWERS}) a join ({_BATCH}) b using (part) group by 1, 2")(lambda t: K.attributed(t.sql(_ANSWERS), t.sql(_BATCH)))
_JUDGED = f"select distinct kind, concat('g', cast(part % 50 as string)) as generated, concat('r', cast(supplier % 20 as string)) as reference from ({model.LINES}) l"
query("unaudited_pairs", f"with p as ({_JUDGED}) select kind, count(*) as proposed, count(*) filter (where length(generated) = 2) as unaudited from p group by 1")(
    lambda t: K.unaudited(t.sql(_JUDGED), t.sql(_JUDGED).filter("length(generated) <> 2"))
)
query("answer_sources", "select distinct l_orderkey as question, 'src' || l_suppkey * 2 as source from lineitem where l_suppkey * 2 in (select s_suppkey from supplier)")(
    lambda t: K.answer_sources(t.lineitem.groupBy(F.col("l_orderkey").alias("question")).agg(F.collect_list(F.concat(F.lit("src"), (F.col("l_suppkey") * 2).cast("string"))).alias("sources")), t.supplier.select(F.concat(F.lit("src"), F.col("s_suppkey").cast("string")).alias("id")))
)
_RANKED = "select distinct concat('src/m', cast(s_nationkey % 12 as string)) as path from supplier union select 'src'"
query("tree_evidence", f"{_WITH}, r as ({_RANKED}) select r.path, count(f.path) as files, count(*) filter (where f.pos % 2 = 0) as sources from r left join files f on starts_with(f.path, r.path || '/') group by 1")(
    lambda t: K.tree_evidence(t.sql(_RANKED), t.sql(model.FILES).withColumn("kind", F.when(F.col("pos") % 2 == 0, "source").otherwise("test")))
)
_STEPS = f"select use_case, pos, concat('a', cast(part % 6 as string)) as actor, part % 2 = 0 as human from ({model.LINES}) l"
_STARTS = f"select use_case, case when supplier % 3 = 0 then 'route' else 'job' end as kind from ({model.LINES}) l where nth < 3 and supplier % 5 > 0"
query("invented_humans", f"with s as ({_STEPS}), e as (select use_case, bool_or(kind = 'route') as person from ({_STARTS}) x group by 1) select use_case, pos, case when human and not coalesce(person, true) then 'System' else actor end as actor, human and coalesce(person, true) as human from s left join e using (use_case)")(
    lambda t: K.without_invented_humans(t.sql(_STEPS), t.sql(_STARTS))
)
