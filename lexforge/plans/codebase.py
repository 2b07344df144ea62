"""Queries of sources, graphs and scores, on code-like records made from the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import graphs as G
from lexforge.operators import matching as M
from lexforge.operators import reach as R
from lexforge.operators import scoring as C
from lexforge.plans.registry import query
from lexforge.sources import files as S
from lexforge.streaming import incremental

_EXT = ["py", "rb", "md", "ts", "txt", "spec.js", "gradle.kts", "scala"]
_PATH_SQL = "case p_partkey % 5 when 0 then 'tests/' when 1 then 'src/app/' when 2 then '' else 'lib/' end || replace(lower(p_brand), '#', '_') || '/' || 'part' || p_partkey || '.' || (list_value('py', 'rb', 'md', 'ts', 'txt', 'spec.js', 'gradle.kts', 'scala'))[1 + p_partkey % 8]"


def _paths(t):
    k = F.col("p_partkey")
    folder = F.when(k % 5 == 0, "tests/").when(k % 5 == 1, "src/app/").when(k % 5 == 2, "").otherwise("lib/")
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXT]), (1 + k % 8).cast("int"))
    return t.part.select("p_partkey", F.concat(folder, F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")), F.lit("/part"), k.cast("string"), F.lit("."), ext).alias("path"))


_TEST = r"(len(list_filter(string_split(lower(path), '/')[:-2], lambda x: x in ('tests', 'test', 'spec', 'specs', '__tests__', 'e2e'))) > 0 or regexp_matches(regexp_replace(lower(string_split(path, '/')[-1]), '\.[^.]*$', ''), '(_test|_spec|\.test|\.spec)$') or starts_with(regexp_replace(lower(string_split(path, '/')[-1]), '\.[^.]*$', ''), 'test_'))"
_KIND = rf"(case when regexp_extract(path, '[^/]\.([^./]+)$', 1) in ('md', 'mdx') then 'markdown' when regexp_matches(path, '\.gradle\.kts$') then 'other' when regexp_extract(path, '[^/]\.([^./]+)$', 1) in ({', '.join(repr(c) for c in S.CODE)}) then case when {_TEST} then 'test' else 'source' end else 'other' end)"

query("file_kinds", f"with f as (select p_partkey, {_PATH_SQL} as path from part) select p_partkey, path, {_KIND} as kind from f")(lambda t: _paths(t).withColumn("kind", S.file_kind(F.col("path"))))
query("source_promotion", f"with f as (select p_partkey, {_PATH_SQL} as path from part), k as (select *, {_KIND} as kind from f) select p_partkey, path, case when kind = 'other' and suffix(path, '.txt') then case when {_TEST} then 'test' else 'source' end else kind end as kind from k")(
    lambda t: S.promote(_paths(t).withColumn("kind", S.file_kind(F.col("path"))), ["txt", "yml"], ["yml"])
)
query("role_classes", f"with f as (select p_partkey, {_PATH_SQL} as path from part) select p_partkey, path, case when regexp_matches(path, '^tests/') then 'tests' when regexp_matches(path, '^src/app/[^/]*/[^/]*\\.py$') then 'logic' when regexp_matches(path, '^(.*/)?[^/]*\\.md$') then 'docs' when regexp_matches(path, '^lib/') then 'library' end as role from f")(
    lambda t: S.classify(_paths(t), [("**/*.md", "docs", 1), ("lib/**", "library", 1), ("src/app/*/*.py", "logic", 0), ("tests/**", "tests", 0)])
)
query("tree_overview", f"with f as (select string_split({_PATH_SQL}, '/') as p from part), k as (select unnest(list_distinct(list_filter([case when len(p) > 1 then p[1] when len(p) = 1 then '.' end, case when len(p) > 2 then p[1] || '/' || p[2] when len(p) = 1 then '.' end], lambda x: x is not null))) as folder from f) select folder, count(*) as files from k group by 1")(
    lambda t: S.tree_overview(_paths(t))
)


def _markdown(t):
    turn = F.concat(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("## Turn "), F.col("turn").cast("string"), F.lit("\n"))).otherwise("```\n# no heading\n```\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"]), "").alias("content"))


query("sections")(lambda t: S.sections(_markdown(t), "conv_id", "content"))
query("test_phrases", r"""with c as (select p_brand, string_agg(case p_partkey % 4 when 0 then 'def test_' || replace(p_name, ' ', '_') || '():' when 1 then '  it("' || p_name || '", () => {' when 2 then 'items "' || p_name || '"' else 'describe ''' || p_type || ''' do' end, chr(10) order by p_partkey) as content from part group by 1), l as (select p_brand, list_transform(string_split(content, chr(10)), lambda x: trim(x)) as ls from c), f as (select p_brand, list_filter(list_transform(ls, lambda x: case when starts_with(x, 'def test_') then trim(replace(regexp_extract(x, '^def test_([\p{L}\p{N}_]*)', 1), '_', ' ')) else regexp_extract(x, '^(?:describe|context|feature|scenario|specify|example|test|it)(?:\(\s*| +)["''`]([^"''`]*)', 1) end), lambda x: x <> '') as fs from l) select p_brand, list_transform(list_sort(list_transform(list_distinct(fs), lambda y: {'p': list_position(fs, y), 'v': y})), lambda z: z.v)[1:30] as phrases from f""")(
    lambda t: t.part.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("def test_"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("():"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit('  it("'), "p_name", F.lit('", () => {'))).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit('items "'), "p_name", F.lit('"'))).otherwise(F.concat(F.lit("describe '"), "p_type", F.lit("' do"))).alias("l")))), lambda x: x["l"]), "\n").alias("content")).select("p_brand", S.phrases(F.col("content")).alias("phrases"))
)
query("schema_tables", "select p_brand, cast(0 as int) as table_no, 'app.' || replace(lower(p_brand), '#', '_') as name, list('c' || p_partkey order by p_partkey) as columns from part group by p_brand")(
    lambda t: S.sql_tables(t.part.groupBy("p_brand").agg(F.concat(F.lit('-- x\nCREATE TABLE IF NOT EXISTS "app".'), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")), F.lit(" (\n"), F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda k: F.concat(F.lit("  `c"), k.cast("string"), F.lit("` int,\n"))), ""), F.lit("  PRIMARY KEY (id)\n);\n")).alias("content")), "p_brand", "content")
)
query("migration_names", r"""with m as (select case p_partkey % 3 when 0 then 'V' || p_partkey || '__' || replace(p_name, ' ', '_') when 1 then '2024' || lpad(p_partkey::varchar, 6, '0') || '_add_' || replace(p_name, ' ', '-') else 'init' end as stem from part), w as (select stem, trim(regexp_replace(regexp_replace(regexp_replace(stem, '^[Vv]([0-9])', '\1'), '^([0-9][0-9a-fA-F.]*[_-]+)+', ''), '[_-]+', ' ', 'g')) as words, try_cast(regexp_extract(stem, '^[Vv]?([0-9]+)', 1) as hugeint) as version from m), k as (select * from w where words not in ('', 'init') order by version desc nulls first, stem desc limit 150) select stem, words, row_number() over (order by version nulls last, stem) as place from k""")(
    lambda t: S.migrations(t.part.select(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("V"), F.col("p_partkey").cast("string"), F.lit("__"), F.replace("p_name", F.lit(" "), F.lit("_")))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("2024"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit("_add_"), F.replace("p_name", F.lit(" "), F.lit("-")))).otherwise("init").alias("stem")), "stem", 150).select("stem", "words", "place")
)


@query("commit_subject_filter", r"""with c as (select event_id as pos, case event_id % 6 when 0 then 'feat(' || event_type || '): value ' || (event_id % 50) when 1 then 'Merge branch ' || event_type when 2 then 'fix: user  ' || user_id when 3 then 'chore(deps): bump x' else event_type || ' by ' || user_id end as subject, case when event_id % 11 = 0 then 'dependabot[bot]' else 'u' || user_id end as author from events), k as (select * from c where not (lower(author) like '%[bot]%' or lower(subject) like 'merge branch%' or lower(subject) like 'chore(deps)%')), f as (select * from k qualify row_number() over (partition by trim(regexp_replace(lower(subject), '\s+', ' ', 'g')) order by pos) = 1), s as (select count(*) filter (where regexp_matches(subject, '^[a-z]+(\([^:]*\))?!?: ')) * 10 >= count(*) * 3 as conv from f) select pos, subject, case when conv then case when subject like 'feat%' then 0 when subject like 'fix: %' then 1 else 2 end else 0 end as bucket from f, s""")
def commit_subject_filter(t):
    e = F.col("event_id") % 6
    subject = F.when(e == 0, F.concat(F.lit("feat("), "event_type", F.lit("): value "), (F.col("event_id") % 50).cast("string"))).when(e == 1, F.concat(F.lit("Merge branch "), "event_type")).when(e == 2, F.concat(F.lit("fix: user  "), F.col("user_id").cast("string"))).when(e == 3, "chore(deps): bump x").otherwise(F.concat("event_type", F.lit(" by "), F.col("user_id").cast("string")))
    author = F.when(F.col("event_id") % 11 == 0, "dependabot[bot]").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return S.commit_subjects(t.events.select(F.col("event_id").alias("pos"), subject.alias("subject"), author.alias("author")), "subject", "author", "pos")


query("route_segments", r"select page_id, list_transform(list_filter(string_split(regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[?#].*$', ''), '/'), lambda x: x <> ''), lambda x, i: case when regexp_matches(x, '^[:{<*]') then '*' when i = len(list_filter(string_split(regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[?#].*$', ''), '/'), lambda y: y <> '')) then string_split(x, '.')[1] else x end) as segments from pages")(
    lambda t: t.pages.select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*", ""), "[?#].*$", "").alias("p")).select("page_id", T.route_segments(F.col("p")).alias("segments"))
)


query("bounded_reach", "with e as (select distinct l_suppkey as src, l_partkey as dst from lineitem), b as (select distinct x.src as start, y.src as node from e x join e y on x.dst = y.dst where x.src <> y.src), r as (select start, node from b union select p.start, q.node from b p join b q on p.node = q.start where p.start <> q.node) select start, count(*) as reached from r group by 1")(lambda t: R.reach_counts(t.lineitem.select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("grp")), 2))


@query("slice_reach")
def slice_reach(t):
    docs = t.documents.select(F.concat(F.lit("src/"), "source", F.lit("/"), "lang", F.lit("/d"), F.col("doc_id").cast("string")).alias("src"), T.statement_words(F.col("text")).alias("w"))
    words = docs.select("src", F.explode("w").alias("key"))
    return G.named_slice(words.withColumn("n", F.lit(1)), words.select("key", F.col("src").alias("dst")), docs.select(F.col("src").alias("start")), 2, 8)


@query("rule_merge")
def rule_merge(t):
    pairs = M.similar_statements(t.documents, "doc_id", "source", "text")
    return G.complete_link_merge(G.with_parts(pairs))


_STATED = "select doc_id as pos, concat('f', cast(doc_id % 40 as string)) as feature, text as statement from documents"
_CITED = "select doc_id as pos, concat('file', cast(doc_id % 7 as string)) as path, case when doc_id % 11 = 0 then null else doc_id % 60 end as first, case when doc_id % 13 = 0 then null else doc_id % 60 + 5 end as last from documents"


@query("rule_duplicates", rf"""with d as ({_STATED}), w as (select pos, feature, list_distinct(list_filter(regexp_split_to_array(lower(statement), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) > 3)) as ws from d),
e as (select pos, feature, len(ws) as n, unnest(ws) as w from w), p as (select x.pos as a, y.pos as b, any_value(x.feature) as ga, any_value(y.feature) as gb, count(*) / (any_value(x.n) + any_value(y.n) - count(*)) as similarity from e x join e y on x.w = y.w and x.pos < y.pos and x.feature <> y.feature group by 1, 2),
c as (select pos, path, case when first is null or last is null then 0 else first end as s, case when first is null or last is null then 4294967295 else last end as z from ({_CITED}) q)
select a, b, ga, gb, similarity from p where similarity >= 0.75 or similarity >= 0.6 and exists (select 1 from c x join c y on x.path = y.path and x.s <= y.z and y.s <= x.z where x.pos = a and y.pos = b)""")
def rule_duplicates(t):
    return M.rule_duplicates(t.sql(_STATED), t.sql(_CITED).withColumnsRenamed({"first": "start", "last": "end"}))


# The greedy merge has no SQL; the tests hold it against plain Python.
@query("merged_rules")
def merged_rules(t):
    k = F.col("pos")
    rules = t.sql(_STATED).select(k.alias("id"), F.concat("feature", F.lit("-"), k.cast("string")).alias("slug"), (k % 3 == 0).alias("owns"), (k % 2 == 0).alias("backed"), (k % 5).alias("files"), F.array(F.concat(F.lit("E"), (k % 4).cast("string"))).alias("entities"), F.when(k % 6 > 0, (k % 10) / 10.0).cast("double").alias("confidence"))
    return G.merged_rules(rule_duplicates(t.spark, t.sf_dir), rules)


query("settle_duplicates", "select l_partkey, l_suppkey, l_orderkey from lineitem qualify row_number() over (partition by l_partkey order by case when l_suppkey % 7 = 0 then 1 else 0 end desc, l_orderkey * 10 + l_linenumber) = 1")(
    lambda t: G.settle_duplicates(t.lineitem.select("l_partkey", "l_suppkey", "l_orderkey", (F.col("l_suppkey") % 7 == 0).alias("own"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos")), "l_partkey", "own", "pos").drop("own", "pos")
)
query("set_apart", "select doc_id, list_filter([case when doc_id % 10 = 0 then 'back office' end, case when (doc_id % 100) / 100.0 < 0.8 then 'technical language' end, case when doc_id % 3 <> 0 and (doc_id % 37) / 37.0 < 0.6 then 'low confidence' end], lambda x: x is not null) as reasons from documents")(
    lambda t: t.documents.select("doc_id", C.set_apart_reasons(F.col("doc_id") % 10 == 0, (F.col("doc_id") % 100) / 100.0, F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 37) / 37.0)).alias("reasons"))
)
query("rule_confidence", "select p_partkey, case when p_size % 2 = 0 and p_partkey % 3 = 0 then 0.85 when p_size % 2 = 0 or p_partkey % 3 = 0 then 0.7 else 0.4 end::double as confidence from part")(
    lambda t: t.part.select("p_partkey", C.rule_confidence(F.col("p_size") % 2 == 0, F.col("p_partkey") % 3 == 0).alias("confidence"))
)
query("business_language", r"""with w as (select doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda r: {'r': r, 't': regexp_replace(regexp_replace(r, '^[.,;:!?"''()\[\]{}]+', ''), '[.,;:!?"''()\[\]{}]+$', '')}), lambda x: x.t <> '') as ts from documents), l as (select doc_id, text, len(list_distinct(list_transform(list_filter(ts, lambda x: contains(x.r, '()') or contains(x.t, '::') or (contains(x.t, '_') and regexp_matches(x.t, '\p{L}')) or regexp_matches(lower(x.t), '\.(rb|rs|js|ts|erb|yml|yaml|py|go|java|php)$') or (contains(x.t, '/') and strlen(x.t) > 5 and lower(x.t) <> 'and/or') or x.t in ('GET', 'POST', 'PUT', 'PATCH', 'DELETE') or lower(x.t) in ('""" + "', '".join(T.TECHNICAL_WORDS) + r"""') or (regexp_matches(x.t, '^\p{Lu}[\p{L}\p{N}]*$') and regexp_matches(x.t, '[\p{Ll}\p{N}]\p{Lu}') and regexp_matches(x.t, '\p{Ll}'))), lambda x: lower(x.t)))) as leaks from w), n as (select doc_id, ' ' || array_to_string(list_transform(list_filter(regexp_split_to_array(lower(regexp_replace(text, '([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g')), '[^\p{L}\p{N}]+'), lambda x: x <> ''), lambda x: case when suffix(x, 's') and strlen(x) > 4 then x[:-2] else x end), ' ') || ' ' as ws from documents) select doc_id, round(case when coalesce(trim(text), '') = '' then 0.0 else greatest(0.0, 1 - least(leaks * 0.15, 0.6) - case when contains(ws, ' of the ') or contains(ws, ' in the ') then 0.0 else 0.3 end - case when doc_id % 4 = 0 then 0.0 else 0.2 end) end, 6)::double as score from l join n using (doc_id)""")(
    lambda t: t.documents.select("doc_id", F.round(C.business_language(F.col("text"), ["OfThe", "in the"], F.col("doc_id") % 4 == 0), 6).alias("score"))
)
query("reconciliation", "with a as (select o_custkey as id, case when o_orderkey % 13 = 0 then null when o_orderkey % 7 = 0 then 'contradicts' when o_orderkey % 3 = 0 then 'covers' else 'unrelated' end as answer from orders), g as (select id, count(*) as n, count(answer) as j, bool_or(answer = 'contradicts') as x, bool_or(answer = 'covers') as c from a group by 1) select c_custkey as id, case when n is null then 'undocumented' when j < n then 'matched' when x then 'contradicted' when c then 'documented' else 'undocumented' end as verdict from customer left join g on id = c_custkey")(
    lambda t: C.reconcile(t.customer.select(F.col("c_custkey").alias("id")), t.orders.select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderkey") % 13 == 0, None).when(F.col("o_orderkey") % 7 == 0, "contradicts").when(F.col("o_orderkey") % 3 == 0, "covers").otherwise("unrelated").alias("answer")), "id", "answer")
)


@query("debt_list", "with p as (select p_partkey as id, (p_size % 10) / 10.0 as score, count(l_orderkey) as commits, count(distinct l_suppkey) as entry_points from part left join lineitem on l_partkey = p_partkey group by p_partkey, p_size), b as (select *, 'low_confidence' as kind, 1.0 as weight, 0 as kind_order from p where score < 0.5 and id % 9 <> 0 union all select id, null, commits, entry_points, 'undocumented', 0.5, 7 from p where id % 4 = 0 union all select id, null, commits, entry_points, 'no_domain', 0.25, 12 from p where id % 10 = 0) select id, score::double as score, commits, entry_points, kind, weight::double as weight, kind_order, round(weight * coalesce(1 - score, 1.0) * (1 + ln(1 + commits)) * (1 + ln(1 + entry_points)), 6) as priority from b")
def debt_list(t):
    p = t.part.select(F.col("p_partkey").alias("id"), ((F.col("p_size") % 10) / 10.0).alias("score")).join(t.lineitem.groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("commits"), F.count_distinct("l_suppkey").alias("entry_points")), "id", "left").fillna(0, ["commits", "entry_points"])
    none = p.withColumn("score", F.lit(None).cast("double"))
    return C.debt_list({"low_confidence": p.filter("score < 0.5"), "undocumented": none.filter("id % 4 = 0"), "no_domain": none.filter("id % 10 = 0")}, p.filter("id % 9 = 0").select("id"), ["low_confidence"])


query("usage_windows", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as calls, round(sum(value), 4) as value from events group by all")(
    lambda t: incremental.usage_windows(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], ["value"]).withColumn("value", F.round("value", 4))
)
