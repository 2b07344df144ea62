"""Queries of links between records."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.operators import links as J
from lexforge.operators import selection as L
from lexforge.plans import model
from lexforge.plans import sqltext as S
from lexforge.plans.registry import query

_WITH = f"with domains as ({model.DOMAINS}), features as ({model.FEATURES}), use_cases as ({model.USE_CASES}), files as ({model.FILES}), lines as ({model.LINES})"

query("use_cases_of_feature", f"{_WITH} select feature, list(slug order by pos) as children from use_cases group by 1")(lambda t: J.children(t.sql(model.USE_CASES), "feature", "slug", "pos"))

_RESOURCES = "select concat('d', cast(s_nationkey as string)) as domain, concat('R-', cast(s_suppkey % 60 as string), 's') as resource from supplier where s_nationkey < 12"
_ENTRIES = f"select distinct id, case when part % 3 = 0 then upper(resource) else resource end as resource, path from ({model.LINES}) l where nth = 1"
_PATHS = f"select concat('d', cast(nation as string)) as domain, path from ({model.FILES}) f"
_ROUTED = f"select distinct id, concat('d', cast(supplier % 25 as string)) as source, concat('d', cast((supplier + 1) % 25 as string)) as target from ({model.LINES}) l where part % 10 = 1 and nth = 1"


@query("domain_entries", f"""with e as ({_ENTRIES}), r as ({_RESOURCES}), p as (select distinct domain, path from ({_PATHS}) x), m as ({_ROUTED}),
n as (select distinct domain, id from (select *, {S.normalized('resource')} as k from e) e join (select domain, {S.normalized('resource')} as k from r) r using (k)),
h as (select domain, id from e join p using (path) where not exists (select 1 from m where m.id = e.id and source = domain) union select target, m.id from m where m.id in (select id from e))
select domain, id from n union select domain, id from h where domain not in (select domain from r)""")
def domain_entries(t):
    return J.domain_entries(t.sql(_ENTRIES), t.sql(_RESOURCES), t.sql(_PATHS), t.sql(_ROUTED))


query("support_files", f"{_WITH} select path, name from files where path not in (select path from lines where part % 900 = 0) and pos % 4 <> 1 and pos % 9 <> 2")(
    lambda t: J.support_files(t.sql(model.FILES), [t.sql(model.LINES).filter("part % 900 = 0"), t.sql(model.FILES).filter("pos % 4 = 1"), t.sql(model.FILES).filter("pos % 9 = 2")]).select("path", "name")
)

_KNOWN = "select p_partkey as pos, concat('src/', p_brand, '.rb#', p_name, cast(p_partkey as string)) as id, case when p_partkey % 3 = 0 then upper(p_name) else p_name end as name from part"
_CITED = "select case p_partkey % 5 when 0 then concat('E', cast(p_partkey as string)) when 1 then concat(' src/', p_brand, '.rb#', p_name, cast(p_partkey as string)) when 2 then p_name when 3 then upper(p_name) else concat('no ', p_name) end as cited from part"


@query("cited_entry_points", f"""with e as ({_KNOWN}), c as (select distinct cited, trim(cited) as c from ({_CITED}) x),
n as (select name, min_by(id, pos) as id from e group by 1 having count(*) = 1), l as (select lower(name) as low, min_by(id, pos) as id from e group by 1 having count(*) = 1)
select cited, coalesce(t.id, i.id, n.id, l.id) as id from c left join e t on t.pos = try_cast(regexp_extract(c, '^[Ee]([0-9]+)$', 1) as bigint) left join e i on i.id = c left join n on n.name = c left join l on low = lower(c) where coalesce(t.id, i.id, n.id, l.id) is not null""")
def cited_entry_points(t):
    return J.known_entries(t.sql(_CITED), t.sql(_KNOWN))


_API = f"select pos, path, case when part % 4 = 0 then 'route' when part % 4 = 1 then 'job' else 'public_api' end as kind from ({model.LINES}) l"
query("reached_public_api", f"with e as ({_API}) select * from e where kind <> 'public_api' or path in (select path from ({model.FILES}) f where pos % 3 = 0)")(
    lambda t: J.without_unreached_api(t.sql(_API), t.sql(model.FILES).filter("pos % 3 = 0").select("path"), L.TRIGGERS)
)

_ENTITY = f"select concat('e', cast(pos % 30 as string)) as entity, path from ({model.FILES}) f"
_NAMED = f"select concat('e', cast(part % 45 as string)) as entity, use_case from ({model.LINES}) l where nth = 2"
query("concept_usage", f"{_WITH} select distinct entity, use_case from ({_ENTITY}) e join lines using (path) union select distinct entity, use_case from ({_NAMED}) n")(
    lambda t: J.concept_usage(t.sql(_ENTITY), t.sql(model.LINES).select("use_case", "path"), t.sql(_NAMED))
)

_RULES = f"select pos as rule, feature, concat(path, cast(start_line as string)) as path from ({model.LINES}) l"
query("neighbour_rules", f"with r as ({_RULES}), m as (select distinct feature, path from r where rule % 300 = 1) select distinct m.feature, r.rule from (select distinct feature, path from r where feature in (select feature from m)) m join r on m.path = r.path and m.feature <> r.feature")(
    lambda t: J.neighbour_rules(t.sql(_RULES), t.sql(_RULES).filter("rule % 300 = 1").select("feature"))
)

_QUESTIONS = "select c_custkey as question, case when c_custkey % 5 = 0 then null else concat('f', cast(c_custkey % 40 as string)) end as feature, concat('g', cast(c_custkey % 7 as string), case when c_custkey % 2 = 0 then '/case' else 'x' end) as source from customer"
_PAIRS = "select concat('f', cast(s_suppkey % 30 as string)) as reference, concat('g', cast(s_suppkey % 7 as string)) as generated from supplier"
query("question_groups", f"with q as ({_QUESTIONS}), p as (select distinct * from ({_PAIRS}) x) select question, case when feature is null then 'undocumented' when feature in (select reference from p) then 'covered' else 'uncovered' end as \"group\", exists (select 1 from p where reference = feature and (source = generated or starts_with(source, generated || '/'))) as hit from q")(
    lambda t: J.question_groups(t.sql(_QUESTIONS), t.sql(_PAIRS))
)
