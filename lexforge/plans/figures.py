"""Queries of figures, ranges, samples and excerpts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.operators import figures as A
from lexforge.plans import model
from lexforge.plans import sqltext as S
from lexforge.plans.registry import query

_WITH = f"with domains as ({model.DOMAINS}), features as ({model.FEATURES}), use_cases as ({model.USE_CASES}), files as ({model.FILES}), lines as ({model.LINES})"

# Lines may share a number; here each has one row.
_CHUNKS = f"select pos, min(path) as path, min(name) as name, min(description) as description, min(kind) as kind, min(attribute) as attribute from (select pos, path, concat('E', cast(part % 20 as string)) as name, case when pos % 3 = 0 then ' ' when pos % 3 = 1 then null else concat('said by ', use_case) end as description, kind, name as attribute from ({model.LINES}) l) x group by pos"


@query("chunk_entities", f"""with c as ({_CHUNKS}), a as (select path, name, attribute, min(pos * 2) as first from c group by 1, 2, 3 union all select path, name, kind, min(pos * 2 + 1) from c group by 1, 2, 3),
b as (select path, name, attribute, min(first) as first from a group by 1, 2, 3)
select path, name, min_by(description, pos) filter (where trim(description) <> '') as description, (select list(attribute order by first) from b where b.path = c.path and b.name = c.name) as attributes from c group by 1, 2""")
def chunk_entities(t):
    return A.merge_chunk_entities(t.sql(_CHUNKS).withColumn("attributes", F.array("attribute", "kind")), "path", "name", "pos", "description", "attributes")


_COUNTS = "select case when l_linenumber % 2 = 0 then 'placed' else 'cited' end as kind, concat('f', cast(l_suppkey as string)) as id, count(*) as total, count(case when l_quantity > 20 then 1 end) as count from lineitem group by 1, 2"
query("entry_coverage", f"with c as ({_COUNTS}) select kind, sum(count)::bigint as count, sum(total)::bigint as total, round(sum(count) / sum(total), 6) as share from c where id in (select concat('f', cast(s_suppkey as string)) from supplier where s_suppkey % 3 > 0) group by 1")(
    lambda t: A.coverage_shares(t.sql(_COUNTS), t.sql("select concat('f', cast(s_suppkey as string)) as id, k.kind from supplier cross join (select 'placed' as kind union all select 'cited' as kind) k where s_suppkey % 3 > 0"))
)

_MADE, _WANTED = "select p_name as name, p_partkey as k from part where p_partkey % 3 > 0", "select upper(p_name) as name, p_partkey as k from part where p_partkey % 5 > 0"
_DISPUTED = "select 'made' as side, p_name as name from part where p_partkey % 7 = 0 union all select 'wanted', upper(p_name) from part where p_partkey % 11 = 0"


@query("undisputed_score", f"""with d as ({_DISPUTED}), m as (select distinct name, {S.normalized('name')} as k from ({_MADE}) x where name not in (select name from d where side = 'made')), w as (select distinct name, {S.normalized('name')} as k from ({_WANTED}) x where name not in (select name from d where side = 'wanted')),
h as (select (select count(*) from w where k in (select k from m) or name = 'no name') as found, (select count(*) from m where k in (select k from w)) as "right", (select count(*) from m) as made, (select count(*) from w) as wanted)
select found, "right", made, wanted, case when wanted > 0 then found / wanted end as recall, case when made > 0 then "right" / made end as "precision" from h""")
def undisputed_score(t):
    pairs = t.spark.createDataFrame([("no", "no name")], "made string, wanted string")
    return A.score_undisputed(t.sql(_MADE), t.sql(_WANTED), pairs, t.sql(_DISPUTED))


_UNITS = "select l_returnflag as application, l_orderkey as run, sum(l_partkey) as source_files, sum(l_suppkey) as business_chars, count(*) as business_files, sum(l_partkey * 3) as entry_point_chars, count(distinct l_suppkey) as entry_point_files, sum(l_linenumber) as entry_points, count(distinct l_partkey) as domains, sum(l_linenumber * 2) as features, sum(l_linenumber * 7) as use_cases, sum(case when l_returnflag = 'R' then 0 else l_linenumber end) as reconcile_items from lineitem group by 1, 2"
_Y = [("source files per run", "source_files", "runs"), ("characters per business file", "business_chars", "business_files"), ("characters per entry point file", "entry_point_chars", "entry_point_files"), ("entry points per file read", "entry_points", "business_files + entry_point_files"), ("domains per run", "domains", "runs"), ("entry points per domain", "entry_points", "domains"), ("features per domain", "features", "domains"), ("use cases per feature", "use_cases", "features"), ("reconciled items per feature", "nullif(reconcile_items, 0)", "features")]
query("yields", f"with u as ({_UNITS}), s as (select application, count(*) as runs, " + ", ".join(f"sum({c}) as {c}" for c in "source_files business_chars business_files entry_point_chars entry_point_files entry_points domains features use_cases reconcile_items".split()) + " from u group by 1) " + " union all ".join(f"select application, '{n}' as yield, round(({a}) / nullif({b}, 0), 3) as value from s" for n, a, b in _Y))(lambda t: A.yields(t.sql(_UNITS)))

_ITEMS = "select s_nationkey as owner, p_partkey as pos, concat('f', cast(floor(p_partkey / 7) as string)) as file from part join supplier on s_suppkey = p_partkey % 10 + 1 where p_size > 3"


@query("file_ranges", f"""with recursive i as ({_ITEMS}), r as (select owner, file, count(*) as n, min(pos) as f from i group by 1, 2), o as (select *, row_number() over (partition by owner order by f) as k, sum(n) over (partition by owner order by f) - n as a0 from r),
z as (select owner, k, a0 + n as upto, case when n > 4 then a0 + n else 0 end as start, case when n > 4 then [struct_pack(a := a0 + i * 4, z := least(a0 + (i + 1) * 4, a0 + n)) for i in range(0, (n - 1) // 4 + 1)] else [] end as made from o where k = 1
  union all select o.owner, o.k, o.a0 + n, case when n > 4 then o.a0 + n when o.a0 + n - start > 4 then o.a0 else start end,
  case when n > 4 then (case when start < o.a0 then [struct_pack(a := start, z := o.a0)] else [] end) || [struct_pack(a := o.a0 + i * 4, z := least(o.a0 + (i + 1) * 4, o.a0 + n)) for i in range(0, (n - 1) // 4 + 1)] when o.a0 + n - start > 4 and start < o.a0 then [struct_pack(a := start, z := o.a0)] else [] end from z join o on o.owner = z.owner and o.k = z.k + 1),
x as (select owner, unnest(made) as m from z union all select owner, struct_pack(a := start, z := upto) from z where k = (select max(k) from o where o.owner = z.owner) and start < upto)
select owner, m.a::bigint as start, m.z::bigint as "end" from x""")
def file_ranges(t):
    return A.file_ranges(t.sql(_ITEMS), "owner", "pos", "file", 4)


_SIGNALS = "select doc_id as pos, coalesce(lang, 'none') as kind, coalesce(source, '') as origin, coalesce(text, '') as text from documents"


@query("sample_pick", f"""with recursive s as (select kind, pos, length(origin) + 8 as head, length(text) as chars, greatest(150, least(1500, 20000 // count(*) over (partition by kind))) as slice, row_number() over (partition by kind order by pos) as k from ({_SIGNALS}) x),
p as (select kind, 0::bigint as k, 20000::bigint as room, null::bigint as pos, 0::bigint as chars, true as ok from (select distinct kind from s)
  union all select p.kind, s.k, room - head - least(s.chars, slice, room - head), s.pos, least(s.chars, slice, room - head), least(s.chars, slice, room - head) > 0 from p join s on s.kind = p.kind and s.k = p.k + 1 where ok and k is not null)
select kind, pos, chars from p where ok and pos is not null""".replace(" where ok and k is not null)", " where ok)"))
def sample_pick(t):
    return A.pick_samples(t.sql(_SIGNALS), "kind", "pos", "origin", "text", 20_000)


_PIECES = "select conv_id as file, cast(turn as int) as nth, coalesce(text, '') as chunk, turn * 10 + 1 as first, turn * 10 + 10 as last from conversations"
_SCORE = "case when (conv_id_a <= last and conv_id_a + 3 >= first) then 100000 else 0 end + 100 * len(list_filter(['the of', 'and the'], lambda x: contains(lower(chunk), x))) + len(list_filter(['anth', 'er'], lambda x: contains(lower(chunk), x)))"


@query("excerpt_choice", f"""with recursive c as (select *, file % 25 as conv_id_a from ({_PIECES}) x), s as (select file, nth, length(chunk) as size, {_SCORE} as score, row_number() over (partition by file order by case when nth = 0 then 0 else 1 end, -({_SCORE}), nth) as k from c),
p as (select file, 0::bigint as k, 0::bigint as used, null::int as nth, false as took from (select distinct file from s) union all select p.file, s.k, used + case when used + size <= 2000 then size else 0 end, s.nth, used + size <= 2000 from p join s on s.file = p.file and s.k = p.k + 1)
select file, nth from p where took""")
def excerpt_choice(t):
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    a = F.col("file") % 25
    rows = t.sql(_PIECES).withColumn("score", A.excerpt_score(F.col("chunk"), F.col("first"), F.col("last"), lit(["the of", "and the"]), lit(["anth", "er"]), F.array(F.struct(a.alias("a"), (a + 3).alias("z")))))
    return A.excerpt_choice(rows.withColumn("size", F.length("chunk")), "file", "nth", "size", "score", 2000)


_ESTIMATES = "select l_shipmode_ as pass, low, low + 40 as high, measured from (select concat('pass', cast(l_linenumber as string)) as l_shipmode_, l_suppkey * 3 as low, l_partkey as measured from lineitem) x"
query("estimate_accuracy", f"with e as ({_ESTIMATES}) select pass, count(*) as runs, count(*) filter (where measured between low and high) as within, count(*) filter (where measured > high) as above, count(*) filter (where measured < low) as below, round(avg(measured / ((low + high) / 2)), 6) as ratio from e group by 1")(
    lambda t: A.estimate_accuracy(t.sql(_ESTIMATES), "pass")
)
query("read_coverage", f"{_WITH}, r as (select path from files where pos % 4 < 2), w as (select path from files where pos % 3 > 0), b as (select (select count(*) from r) as \"read\", (select count(*) from w) as wanted, (select count(*) from r join w using (path)) as \"both\") select \"read\", wanted, \"both\", round(\"both\" / wanted, 6) as recall, round((\"read\" - \"both\") / \"read\", 6) as noise from b")(
    lambda t: A.read_coverage(t.sql(model.FILES).filter("pos % 4 < 2"), t.sql(model.FILES).filter("pos % 3 > 0"))
)

_NEEDS = "select p_brand as owner, p_size as kind, sum(p_partkey % 700) as need, 1 + max(p_partkey) % 4 as share from part where p_size < 9 group by 1, 2"


@query("water_shares", f"""with recursive n as ({_NEEDS}), o as (select *, row_number() over (partition by owner order by need / share, kind) as k, sum(share) over (partition by owner) as weight from n),
w as (select owner, kind, k, least(need, 3000 * share / weight)::double as given, 3000 - least(need, 3000 * share / weight)::double as room, (weight - share)::double as weight from o where k = 1 union all
  select o.owner, o.kind, o.k, least(o.need, room * o.share / w.weight)::double, room - least(o.need, room * o.share / w.weight)::double, w.weight - o.share from w join o on o.owner = w.owner and o.k = w.k + 1)
select owner, kind, round(given, 6) as given from w""")
def water_shares(t):
    return A.water_shares(t.sql(_NEEDS), "owner", "kind", "need", "share", 3000)


query("durations", "with s as (select o_orderkey, o_orderkey % 9000 as n, (o_orderkey % 9000 + 30) // 60 as m from orders) select o_orderkey, case when n < 60 then n || ' s' when m < 60 then m || ' min' else (m // 60) || ' h ' || lpad((m % 60)::varchar, 2, '0') end as took from s")(
    lambda t: t.orders.select("o_orderkey", A.duration(F.col("o_orderkey") % 9000).alias("took"))
)
