"""Queries of filters and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.operators import selection as L
from lexforge.plans import model
from lexforge.plans import sqltext as S
from lexforge.plans.registry import query

_WITH = f"with domains as ({model.DOMAINS}), features as ({model.FEATURES}), use_cases as ({model.USE_CASES}), files as ({model.FILES}), lines as ({model.LINES})"
_RULES = f"select pos, kind, case when pos % 11 = 0 then 'gone' else feature end as feature from ({model.LINES}) l"

query("rules_filter", f"{_WITH} select r.pos, r.kind, feature, domain from ({_RULES}) r join features f on f.slug = r.feature where r.kind = 'A' and domain = 'd4'")(
    lambda t: L.keep_rules(t.sql(_RULES), t.sql(model.FEATURES), kind="A", domain="d4").select("pos", "kind", "feature", "domain")
)

_ROLES = f"select path, case pos % 5 when 0 then 'tests' when 1 then 'logic' when 2 then 'configuration' when 3 then 'infrastructure' end as role from ({model.FILES}) f where pos % 7 > 0"

query("role_files", f"{_WITH}, roles as ({_ROLES}) select path, role from files join roles using (path) where (role = 'logic' and pos % 2 = 0) or role = 'tests'")(
    lambda t: L.with_role(t.sql(model.FILES), t.sql(_ROLES), "logic", t.sql(model.FILES).filter("pos % 2 = 0").select("path")).select("path", "role")
)
query("mapped_sources", f"{_WITH} select path from files where path not in (select path from ({_ROLES}) r where role in ('configuration', 'infrastructure'))")(
    lambda t: L.mapped_sources(t.sql(model.FILES), t.sql(_ROLES)).select("path")
)
query("unmatched_files", f"{_WITH} select path from files f where not exists (select 1 from ({_ROLES}) r where r.path = f.path and role is not null)")(
    lambda t: t.sql(model.FILES).join(t.sql(_ROLES).filter("role is not null"), "path", "left_anti").select("path")
)

_VERDICTS = "select l_orderkey as run, case l_linenumber % 3 when 0 then concat('R', cast(l_linenumber as string)) when 1 then cast(l_linenumber as string) else concat('rule ', cast(l_linenumber as string)) end as number, case when l_suppkey % 3 = 0 then ' Technical' when l_suppkey % 3 = 1 then 'trivial' else 'good' end as class from lineitem where l_partkey % 2 = 0"
query("noise_rules_dropped", "select l_orderkey as run, cast(l_linenumber as bigint) as n from lineitem x where not exists (select 1 from lineitem v where v.l_orderkey = x.l_orderkey and v.l_linenumber = x.l_linenumber and v.l_partkey % 2 = 0 and v.l_suppkey % 3 < 2)")(
    lambda t: L.drop_noise(t.lineitem.select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").cast("bigint").alias("n")), t.sql(_VERDICTS), ["technical", "trivial"])
)
query("is_application", "select bool_or(event_type in ('click', 'route', 'webhook')) as application from (select case event_type when 'click' then 'route' else event_type end as event_type from events)")(
    lambda t: L.is_application(t.events.select(F.when(F.col("event_type") == "click", "route").otherwise(F.col("event_type")).alias("kind")))
)

_AUTH_PATHS = "select p_partkey as pos, concat('lib/', case p_partkey % 6 when 0 then 'userRoles' when 1 then 'auth_guard' when 2 then 'Policy' when 3 then 'orders' when 4 then 'role-acl' else 'author' end, cast(p_partkey as string), '/', case p_partkey % 4 when 0 then 'AbilityOf' when 1 then 'session_auth' when 2 then 'roles.spec' else 'plain' end, '.rb') as path from part"
_AUTH = S.listing(L.AUTH_WORDS)
query("authorization_files", rf"""with f as ({_AUTH_PATHS}), w as (select path, list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(string_split(path, '/')[-1], '\.[^.]*$', ''), '([\p{{Ll}}\p{{N}}])(\p{{Lu}})', '\1 \2', 'g')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') as ws from f)
select path, list_min(list_transform(list_filter(ws, lambda x: x in ({_AUTH})), lambda x: list_position([{_AUTH}], x) - 1)) as rank from w where len(list_filter(ws, lambda x: x in ({_AUTH}))) > 0""")(lambda t: L.authorization_files(t.sql(_AUTH_PATHS)))

_SLUGS = "select p_partkey as pos, concat_ws('-', case p_partkey % 3 when 0 then 'business' when 1 then 'common' else 'shared' end, case p_partkey % 4 when 0 then 'misc' when 1 then 'business' when 2 then 'orders' else 'various' end) as slug from part"
query("catch_all_names", f"with s as ({_SLUGS}), w as (select *, list_filter(string_split(slug, '-'), lambda x: x <> 'business') as ws from s) select pos, slug, len(ws) > 0 and len(list_filter(ws, lambda x: x not in ({S.listing(L.CATCH_ALL)}))) = 0 as catch_all from w")(
    lambda t: t.sql(_SLUGS).withColumn("catch_all", L.is_catch_all(F.col("slug")))
)

query("restricted_features", f"{_WITH} select feature as slug, list(id order by pos, id) as entry_points from lines where supplier % 4 = 0 group by 1")(
    lambda t: L.restricted(
        t.sql(model.LINES).groupBy(F.col("feature").alias("slug")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("entry_points")),
        t.sql(model.LINES).filter("supplier % 4 = 0").select(F.col("id").alias("entry")), "slug", "entry_points"
    )
)

_BUSINESS = "select p_partkey as rank, case p_partkey % 3 when 0 then concat('./src/m', cast(p_partkey % 9 as string), '/') when 1 then concat('src/m', cast(p_partkey % 9 as string), '/file_', cast(p_partkey as string), '.py') else 'nowhere' end as path from part where p_partkey % 5 = 2"
query("business_files", f"{_WITH}, b as (select rank, regexp_replace(regexp_replace(path, '^\\./', ''), '/$', '') as a from ({_BUSINESS}) x), h as (select path, min(rank) as rank from files join b on path = a or starts_with(path, a || '/') group by 1) select row_number() over (order by rank, path) as place, path from h qualify place <= 60")(
    lambda t: L.expand_files(t.sql(_BUSINESS), t.sql(model.FILES))
)
query("arranged_by_map", f"{_WITH} select path, n.n_regionkey as place from files join nation n on n_nationkey = nation where n_regionkey < 3")(
    lambda t: L.arranged(t.sql(model.FILES), t.nation.filter("n_regionkey < 3").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("place")), "nation").select("path", "place")
)
