"""Queries of step checks, debts and the rows of domains."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.operators import debt as D
from lexforge.operators import selection as L
from lexforge.operators.ranking import DEBT_WEIGHTS
from lexforge.operators.scoring import LOW
from lexforge.plans import model
from lexforge.plans.registry import query

# ---- checks of steps: a document's step calls or reads the first longer word of its own text

_WORD = "regexp_extract(lower(text), '([a-z][a-z][a-z][a-z]+)', 1)"
_STEPS = f"select doc_id as step, case doc_id % 3 when 0 then concat('calls `', {_WORD}, '` now') when 1 then concat('reads the ', {_WORD}, ' rows') else 'is done' end as text from documents"
_REFS = "select doc_id as step, case when doc_id % 8 = 7 then doc_id + 1 else doc_id end as path, case when doc_id % 5 = 0 then null else doc_id % 4 end as start_line, case when doc_id % 2 = 0 then null else doc_id % 4 + 1 end as end_line from documents where doc_id % 10 <> 9"
_CONTENT = "select doc_id as path, text as content from documents where text is not null"
_ENTITIES = f"select distinct {_WORD} as entity from documents where doc_id % 4 = 1"


@query("step_checks", rf"""
with s as ({_STEPS}), r as ({_REFS}), f as ({_CONTENT}), e as (select entity from ({_ENTITIES}) where length(entity) >= 4),
l as (select step, path, content, regexp_split_to_array(content, '\r?\n') as ls, coalesce(start_line, end_line) as a, greatest(coalesce(end_line, start_line), coalesce(start_line, end_line)) as z from r left join f using (path)),
n as (select *, len(ls) - case when ls[len(ls)] = '' then 1 else 0 end as n from l),
c as (select step, coalesce(content is null or a < 1 or a > n, false) as broken, lower(case when a is null then content else array_to_string(ls[greatest(a, 1):greatest(a, 1) + z - a], chr(10)) end) as cited, lower(content) as content from n),
k as (select s.step, s.text, broken, cited, content, regexp_extract(s.text, '`([a-z]+)`', 1) as named, (select list(entity) from e where contains(lower(s.text), entity) and list_contains(regexp_extract_all(lower(s.text), '[\p{{L}}\p{{N}}]+'), entity)) as told, c.step is not null as grounded from s left join c on s.step = c.step)
select step, case when not grounded then 'ungrounded' when broken then 'broken' when named <> '' and not contains(cited, named) then 'doubtful' when len(list_filter(coalesce(told, []), lambda x: not contains(content, x))) > 0 then 'doubtful' when named = '' and told is null then 'doubtful' else 'pass' end as "check" from k""")
def step_checks(t):
    return D.step_checks(t.sql(_STEPS), t.sql(_REFS), t.sql(_CONTENT), t.sql(_ENTITIES))


# ---- the report and the list

_WITH = f"with domains as ({model.DOMAINS}), features as ({model.FEATURES}), use_cases as ({model.USE_CASES}), files as ({model.FILES}), lines as ({model.LINES})"
_UNCATEGORIZED = f"select path from ({model.FILES}) f where pos % 10 = 0"
_REASONS = "list_filter([case when coalesce(back_office, false) then 'back office' end, case when business < 0.8 then 'technical language' end, case when confidence < 0.6 then 'low confidence' end], lambda x: x is not null)"

_REPORT = f"""{_WITH}, cases as (select u.slug as id, u.feature, u.confidence, u.business, u.narrative_check, f.domain, f.back_office from use_cases u left join features f on f.slug = u.feature),
lone as (select slug as id, domain, slug as feature, confidence from features f where not exists (select 1 from use_cases u where u.feature = f.slug)),
why as (select *, {_REASONS} as reasons from cases), none as (select []::varchar[] as reasons),
report as (select 'weak' as kind, id, domain, feature, confidence as score, reasons from cases, none where confidence < 0.5
  union all select 'weak', id, domain, feature, confidence, reasons from lone, none where confidence < 0.5
  union all select 'not_scored', id, domain, feature, null, reasons from cases, none where confidence is null
  union all select 'technical', id, domain, feature, business, reasons from cases, none where business < 0.5
  union all select 'unbacked', id, domain, feature, narrative_check, reasons from cases, none where narrative_check <= 0
  union all select 'set_apart', id, domain, feature, null, reasons from why where len(reasons) > 0
  union all select 'featureless', id, domain, feature, null, reasons from lone, none
  union all select 'uncategorized', path, null, null, null, reasons from ({_UNCATEGORIZED}), none)"""


def _report(t):
    return D.report(t.sql(model.FEATURES), t.sql(model.USE_CASES), t.sql(_UNCATEGORIZED))


query("debt_report", f"{_REPORT} select * from report")(_report)
query("weak_section_order", f"{_REPORT} select domain, id, score, row_number() over (partition by domain order by score, feature nulls first, id) as place from report where kind = 'weak'")(
    lambda t: D.weak_order(_report(t).filter("kind = 'weak'")).select("domain", "id", "score", "place")
)

_ENTRIES = f"select kind, id as entry, pos from ({model.LINES}) l"
_FOLDER = "case when regexp_extract(string_split(entry, '#')[1], '^(.*)/[^/]*$', 1) = '' then '.' else regexp_extract(string_split(entry, '#')[1], '^(.*)/[^/]*$', 1) end"
_CODE = f"""code as (select kind, {_FOLDER} as id, count(*) as entries from (select 'entry_point_without_feature' as kind, id as entry from lines where pos % 50 = 0
  union all select 'no_domain', path from files where pos % 10 = 0 union all select 'no_behaviour', path from files where pos % 7 = 0 union all select 'not_analysed', path from files where pos % 13 = 0) group by 1, 2)"""


def _code(t):
    lines, files = t.sql(model.LINES), t.sql(model.FILES).withColumnRenamed("path", "entry")
    return D.code_debts({"entry_point_without_feature": lines.filter("pos % 50 = 0").select(F.col("id").alias("entry")), "no_domain": files.filter("pos % 10 = 0"), "no_behaviour": files.filter("pos % 7 = 0"), "not_analysed": files.filter("pos % 13 = 0")})


query("code_debts", f"{_WITH}, {_CODE} select * from code")(_code)

_JUDGED = {"weak": "low_confidence", "not_scored": "not_scored", "unbacked": "unbacked_narrative", "technical": "technical_language"}
_RENAMED = " ".join(f"when '{a}' then '{b}'" for a, b in _JUDGED.items())
_WEIGHTS = ", ".join(f"('{k}', {w}, {n})" for n, (k, w) in enumerate(DEBT_WEIGHTS.items()))
#: Reviews and edits: a use case whose order's key ends so is marked, or its files have changed since.
_MARKS = "case when pos % 17 = 0 then 'marked_wrong' when pos % 17 = 1 then 'to_review' when pos % 17 = 2 then 'outdated_edit' when pos % 17 = 3 then 'stale' when pos % 17 = 4 then 'contradicted' when pos % 17 = 5 then 'undocumented' end"


@query("debt_list_all_kinds", f"""{_REPORT}, {_CODE}, weight(kind, weight, kind_order) as (values {_WEIGHTS}),
judged as (select case kind {_RENAMED} end as kind, id, score, 0 as entry_points from report where kind in ('weak', 'not_scored', 'unbacked', 'technical') and id not in (select slug from use_cases where pos % 9 = 0)),
others as (select 'set_apart' as kind, id, null as score, 0 as entry_points from report where kind = 'set_apart'
  union all select kind, id, null, 0 from (select {_MARKS} as kind, slug as id from use_cases) where kind is not null
  union all select kind, id, null, entries from code),
commits as (select use_case as id, count(*) as commits from lines group by 1)
select kind, kind_order, id, round(weight * coalesce(1 - case when kind = 'unbacked_narrative' then null else score end, 1.0) * (1 + ln(1 + coalesce(commits, 0))) * (1 + ln(1 + entry_points)), 6) as priority from (select * from judged union all select * from others) join weight using (kind) left join commits using (id)""")
def debt_list_all_kinds(t):
    r, cases = _report(t), t.sql(model.USE_CASES)
    named = F.create_map(*[F.lit(x) for pair in _JUDGED.items() for x in pair])
    zero = F.lit(0).cast("bigint").alias("entry_points")
    none = F.lit(None).cast("double").alias("score")
    judged = r.filter(F.col("kind").isin(list(_JUDGED))).select(F.element_at(named, F.col("kind")).alias("kind"), "id", "score", zero)
    marks = cases.select(F.expr(_MARKS).alias("kind"), F.col("slug").alias("id"), none, zero).filter("kind is not null")
    others = r.filter("kind = 'set_apart'").select("kind", "id", none, zero).unionByName(marks).unionByName(_code(t).select("kind", "id", none, F.col("entries").alias("entry_points")))
    commits = t.sql(model.LINES).groupBy(F.col("use_case").alias("id")).agg(F.count("*").alias("commits"))
    return D.full_list(judged, others, cases.filter("pos % 9 = 0").select(F.col("slug").alias("id")), commits)


query("debt_filter", f"{_REPORT} select * from report where kind = 'weak' and domain = 'd3'")(lambda t: L.keep(_report(t), {"kind": "weak", "domain": "d3", "feature": None}))

# ---- domains

query("domain_debts", f"{_WITH}, n as (select feature as slug, count(*) as n from use_cases group by 1) select domain, count(*) as features, coalesce(sum(n), 0)::bigint as use_cases, round(avg(confidence), 6) as confidence from features left join n using (slug) group by 1")(
    lambda t: D.domain_debts(t.sql(model.FEATURES), t.sql(model.USE_CASES))
)


@query("domain_rows", f"""{_WITH}, u as (select feature as slug, count(*) as n, bool_or(pos % 40 = 0) as old from use_cases group by 1),
m as (select domain as slug, count(*) as features, sum(coalesce(n, 0))::bigint as use_cases, bool_or(coalesce(old, false)) as stale from features left join u using (slug) group by 1)
select slug, name, coalesce(features, 0) as features, coalesce(use_cases, 0) as use_cases, coalesce(stale, false) as stale, case when pos % 3 = 0 then 'validated' when pos % 3 = 1 then 'wrong' else 'to_review' end as badge, pos % 4 = 0 as edited from domains left join m using (slug)""")
def domain_rows(t):
    domains, cases = t.sql(model.DOMAINS), t.sql(model.USE_CASES)
    reviews = domains.filter("pos % 3 < 2").select("slug", F.when(F.col("pos") % 3 == 0, "validated").otherwise("wrong").alias("status"))
    return D.domain_rows(domains, t.sql(model.FEATURES), cases, cases.filter("pos % 40 = 0").select(F.col("slug").alias("use_case")), reviews, domains.filter("pos % 4 = 0"))


@query("technical_set_aside", f"{_WITH} select technical as aside, count(*) as features, count(distinct domain) as domains from features group by 1")
def technical_set_aside(t):
    stay, aside = D.set_aside(t.sql(model.FEATURES), "technical")
    both = stay.withColumn("aside", F.lit(False)).unionByName(aside.withColumn("aside", F.lit(True)))
    return both.groupBy("aside").agg(F.count("*").alias("features"), F.count_distinct("domain").alias("domains"))

query("low_confidence_sections", f"{_WITH} select slug, confidence from use_cases where confidence < 0.5")(lambda t: t.sql(model.USE_CASES).filter(F.col("confidence") < LOW).select("slug", "confidence"))
