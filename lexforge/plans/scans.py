"""Queries of scans: ignored files, docs, schemas, catalogs, formats, artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators.stores import union_in_order
from lexforge.plans import model
from lexforge.plans.registry import query
from lexforge.sources import catalogs as C
from lexforge.sources.manifests import manifests

_PATHS = "select p_partkey as pos, concat(case p_partkey % 6 when 0 then 'docs/' when 1 then '' when 2 then 'build/out/' when 3 then 'src/tmp/' when 4 then 'src/' else 'Docs/more/' end, 'f', cast(p_partkey as string), case p_partkey % 4 when 0 then '.md' when 1 then '.MDX' when 2 then '.log' else '.py' end) as path from part"
query("walk_without_ignored", f"with f as ({_PATHS}) select * from f where not (starts_with(path, 'build/') or contains(path, '/tmp/') or (suffix(path, '.log') and path <> 'docs/f6.log'))")(
    lambda t: C.without_ignored(t.sql(_PATHS), ["# built", "/build/", "tmp/", "*.log", "!docs/f6.log", "", "/none/*.py"])
)
query("existing_docs", f"with f as ({_PATHS}) select * from f where starts_with(path, 'docs/') and regexp_matches(lower(path), '\\.mdx?$') or path = 'f1.MDX'")(lambda t: C.existing_docs(t.sql(_PATHS), ["./docs/", "f1.MDX"]))
query("root_markdown", f"with f as ({_PATHS}) select * from f where not contains(path, '/') and regexp_matches(lower(path), '\\.mdx?$')")(lambda t: C.root_markdown(t.sql(_PATHS)))

query("active_record_tables", "select p_brand as brand, cast(0 as int) as table_no, 'of_' || replace(lower(p_brand), '#', '_') as name, list('c' || p_partkey order by p_partkey) filter (where p_partkey % 5 > 0) as columns from part group by 1 having count(*) filter (where p_partkey % 5 > 0) > 0")(
    lambda t: C.active_record_tables(
        t.part.groupBy(F.col("p_brand").alias("brand")).agg(
            F.concat(
                F.lit('ActiveRecord::Schema.define do\n  create_table "of_'), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")), F.lit('", force: :cascade do |t|\n'),
                F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda k: F.concat(F.lit("    "), F.when(k % 5 == 0, F.lit("t.index [")).otherwise(F.lit("t.string ")), F.lit('"c'), k.cast("string"), F.lit('", null: false'))), "\n"), F.lit("\n  end\nend\n"),
            ).alias("content")
        ), "brand", "content",
    ).filter(F.size("columns") > 0)
)

_CATALOGS = """select s_suppkey as pos, concat('config/locales/', case s_suppkey % 4 when 0 then 'de' when 1 then 'fr' when 2 then 'pt' else 'base' end, '/f', cast(s_suppkey as string), '.txt') as path from supplier"""
_ONE = f"with f as ({_CATALOGS}), l as (select *, case when pos % 4 < 3 then string_split(path, '/')[3] end as lang from f), p as (select lang from l where lang is not null group by 1 order by count(*) desc, lang desc limit 1), k as (select l.pos, l.path from l, p where l.lang is null or l.lang = p.lang)"


def _texts(t, *pieces):
    """The catalogs' paths with a content in which None stands for the file's number."""
    return t.sql(_CATALOGS).withColumn("content", F.concat(*[F.col("pos").cast("string") if x is None else F.lit(x) for x in pieces]))


query("catalog_properties", f"{_ONE} select path, 'menu.title' as key, 'Title ' || pos as text from k union all select path, 'menu.n' || pos, 'of: ' || pos from k")(
    lambda t: C.one_language(C.properties_entries(_texts(t, "# head\nmenu.title = Title ", None, "\nempty =\n! x\nmenu.n", None, ": of: ", None, "  \n"), "path", "content"))
)
query("catalog_gettext", f"{_ONE} select path, 'Open ' || pos as key, 'Offen ' || pos as text from k union all select path, 'Untold', 'Untold' from k")(
    lambda t: C.one_language(C.gettext_entries(_texts(t, 'msgid ""\nmsgstr "Language: x"\n\n#: a\nmsgid "Open ', None, '"\nmsgstr "Offen ', None, '"\n\nmsgid "Untold"\nmsgstr ""\n'), "path", "content"))
)
query("catalog_yaml", f"{_ONE} select path, 'de.menu.title' as key, 'It''s ' || pos as text from k union all select path, 'de.menu.sub.n' || pos, 'deep' from k union all select path, 'de.end', 'last' from k")(
    lambda t: C.one_language(C.yaml_entries(_texts(t, "# c\nde:\n  menu:\n    title: \"It's ", None, "\"\n    list:\n      - one\n    sub:\n      n", None, ": deep # why\n  end: last\n"), "path", "content"))
)

_SNIFF = "select p_partkey as pos, case p_partkey % 8 when 0 then 'db/schema.rb' when 1 then 'db/x.sql' when 2 then 'db/migrations/001_a.sql' when 3 then 'db/migrate/20240101_add.rb' when 4 then 'config/locales/en.yml' when 5 then 'src/i18n/fr.json' when 6 then 'res/messages_de.properties' else 'po/de.po' end as path, case when p_partkey % 3 = 0 then 'select 1' else concat('-- x', chr(10), 'CREATE TABLE t (') end as content from part"
query("sniffed_formats", f"with f as ({_SNIFF}) select pos, path, case pos % 8 when 0 then 'schema/active_record' when 1 then case when pos % 3 > 0 then 'schema/sql' end when 2 then case when pos % 3 > 0 then 'migration/sql' else 'migration/code' end when 3 then 'migration/code' when 4 then 'catalog/yaml' when 5 then 'catalog/json' when 6 then 'catalog/properties' else 'catalog/gettext' end as format from f")(
    lambda t: t.sql(_SNIFF).select("pos", "path", C.sniff_format(F.col("path"), F.col("content")).alias("format"))
)

_RULES = [("docs", "docs/**"), ("logs", "**/*.log"), ("none", "x/*.y")]


def _checked(t):
    files = t.sql(_PATHS)
    return C.dry_run(files, files.filter("pos % 9 = 0"), _RULES)


_CHECK = f"with f as ({_PATHS}), c as (select 'docs' as rule, 'docs/**' as glob, count(*) as files, count(*) filter (where pos % 9 = 0) as usable from f where starts_with(path, 'docs/') union all select 'logs', '**/*.log', count(*), count(*) filter (where pos % 9 = 0) from f where suffix(path, '.log') union all select 'none', 'x/*.y', 0, 0)"
query("rule_dry_run", f"{_CHECK} select * from c")(_checked)
query("usable_rules", f"{_CHECK} select rule, files > 0 and usable > 0 as kept from c")(
    lambda t: (lambda good, bad: good.select("rule", F.lit(True).alias("kept")).unionByName(bad.select("rule", F.lit(False).alias("kept"))))(*C.usable_rules(_checked(t)))
)
query("text_prefix", "select doc_id, left(text, 0) || array_to_string(list_filter([case when strlen(left(text, 40)) <= 40 then left(text, 40) else (select max(left(text, n)) from range(41) r(n) where strlen(left(text, n)) <= 40) end], lambda x: true), '') as head from documents where text is not null")(
    lambda t: t.documents.filter("text is not null").select("doc_id", C.prefix(F.col("text"), 40).alias("head"))
)
_CITED = "select p_partkey as pos, case p_partkey % 3 when 0 then concat('src/../f', cast(p_partkey as string), '.py') when 1 then concat('src/f', cast(p_partkey as string), '.md') else '/etc/passwd' end as path from part"
query("readable_paths", f"with c as ({_CITED}) select * from c where path in (select path from ({_PATHS}) f) and not contains(path, '..') and not starts_with(path, '/')")(lambda t: C.readable(t.sql(_CITED), t.sql(_PATHS)))

_RUNS = "select n_nationkey as id, concat('runs/s', cast(n_regionkey as string), '/', case when n_nationkey % 6 = 5 then 'notes' else concat('2024-0', cast(1 + n_nationkey % 3 as string), '-11', case when n_nationkey % 2 = 0 then concat('-', cast(n_nationkey + 2 as string)) else '' end) end, '.json') as name, case when n_nationkey % 7 = 0 then 2 when n_nationkey % 7 = 1 then null else 1 end as version from nation"
query("snapshots_in_order", f"with r as ({_RUNS}) select id, name, version, row_number() over (order by regexp_extract(name, '(2024-[0-9]+-[0-9]+)', 1), coalesce(try_cast(regexp_extract(name, '2024-[0-9]+-[0-9]+-([0-9]+)\\.json$', 1) as int), 1), name) as run from r where contains(name, '2024') and coalesce(version, 1) <= 1")(
    lambda t: C.snapshots(t.sql(_RUNS), "name", "version")
)
query("series_scan", f"with r as ({_RUNS}) select id, string_split(name, '/')[2] as series, row_number() over (partition by string_split(name, '/')[2] order by string_split(name, '/')[3]) as place from r")(
    lambda t: C.series(t.sql(_RUNS).unionByName(t.spark.createDataFrame([(99, "runs/.old/a.json", 1)], "id int, name string, version int")), "name").select("id", "series", "place")
)

# ---- manifests: each supplier's file has its own name in it

_FORMS = {
    "go.mod": "module ex/NAME\n// require (\nrequire (\n\tgithub.com/a v1\n\tgithub.com/NAME v2\n)\nrequire single v3\n",
    "pom.xml": "<project><parent><artifactId>up</artifactId></parent><artifactId>NAME</artifactId><description> D </description><dependencies><dependency><artifactId>one</artifactId></dependency><dependency><artifactId> NAME-two </artifactId></dependency></dependencies></project>",
    "Cargo.toml": '[package]\nname = "NAME"\ndescription = "D"\n\n[dependencies]\none = "1"\nNAME-x = { version = "2" }\n\n[dependencies.deep]\nversion = "1"\n\n[dev-dependencies]\nno = "1"\n',
    "pyproject.toml": '[project]\nname = "NAME"\ndependencies = [\n  "one>=1",\n  "NAME-y[z]~=2",\n]\n\n[tool.poetry.dependencies]\npython = "3"\nlate = "1"\n',
    "requirements.txt": "# c\n-r other\none==1\nNAME.z>=2 # x\n",
    "Gemfile": "source 'x'\ngem 'one', '~> 1'\n  gem \"NAME\"\n",
    "build.gradle": "dependencies {\n  implementation 'g:one:1'\n  testImplementation 'g:no:1'\n  api(\"g:NAME:2\")\n}\n",
    "App.csproj": '<Project><Description>D</Description><PackageReference Include="One" Version="1" /><PackageReference Include="NAME" /></Project>',
    "composer.json": '{"name": "NAME", "require": {"one": "1"}, "require-dev": {"NAME": "2"}}',
    "notes.txt": "NAME",
}
#: File, name, description and dependencies, n being the supplier's name.
_TOLD = [
    ("go.mod", "'ex/' || n", "null", "['github.com/a', 'github.com/' || n, 'single']"),
    ("pom.xml", "n", "'D'", "['one', n || '-two']"),
    ("Cargo.toml", "n", "'D'", "['one', n || '-x', 'deep']"),
    ("pyproject.toml", "n", "null", "['one', n || '-y', 'late']"),
    ("requirements.txt", "null", "null", "['one', n || '.z']"),
    ("Gemfile", "null", "null", "['one', n]"),
    ("build.gradle", "null", "null", "['g:one', 'g:' || n]"),
    ("App.csproj", "'App'", "'D'", "['One', n]"),
    ("composer.json", "n", "null", "['one', n]"),
]


@query("manifest_formats", "with s as (select 's' || s_suppkey as n from supplier) " + " union all ".join(f"select n || '/{file}' as path, {name} as name, {told} as description, {deps} as dependencies from s" for file, name, told, deps in _TOLD))
def manifest_formats(t):
    name = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    forms = F.array(*[F.struct(F.lit(k).alias("file"), F.lit(v).alias("form")) for k, v in _FORMS.items()])
    files = t.supplier.select(name.alias("n"), F.explode(forms).alias("x")).select(F.concat_ws("/", "n", "x.file").alias("path"), F.replace("x.form", F.lit("NAME"), F.col("n")).alias("content"))
    return manifests(files)


# ---- scalars of names and citations

query("file_name_words", r"select p_partkey, list_transform(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: case when length(w) > 4 and suffix(w, 'ies') then left(w, length(w) - 3) || 'y' when length(w) > 4 and regexp_matches(w, '(ss|sh|ch|x|z)es$') then left(w, length(w) - 2) when suffix(w, 'ss') or suffix(w, 'us') or suffix(w, 'is') then w when suffix(w, 's') and length(w) >= 4 then left(w, length(w) - 1) else w end) as words from part")(
    lambda t: t.part.select("p_partkey", T.file_name_words(F.col("p_name")).alias("words"))
)
_PROSE = "select p_partkey as pos, concat('Calls `', split_part(p_name, ' ', 1), '_of` then run', cast(p_partkey % 3 as string), '( and getX of Plain ', p_brand) as said from part"
query("code_identifiers", f"with p as ({_PROSE}) select pos, [regexp_extract(said, '`([a-z]+_of)`', 1), 'run' || pos % 3, 'getX'] as named from p")(lambda t: t.sql(_PROSE).select("pos", T.code_identifiers(F.col("said")).alias("named")))
_ENTRY = f"select distinct id, name from ({model.LINES}) l union all select 'Class#method', 'none'"
query("entry_point_names", f"select id, case when id = 'Class#method' then id else name end as named from ({_ENTRY}) e")(lambda t: t.sql(_ENTRY).select("id", T.entry_point_name(F.col("id")).alias("named")))
_SPANS = "select l_orderkey, l_linenumber, case when l_partkey % 3 = 0 then null else l_suppkey end as a, case when l_partkey % 4 = 0 then null else l_linenumber end as z from lineitem"
query("line_spans", f"with s as ({_SPANS}) select l_orderkey, l_linenumber, least(a, coalesce(z, a)) as first, greatest(a, coalesce(z, a)) as last from s where a is not null")(
    lambda t: t.sql(_SPANS).select("l_orderkey", "l_linenumber", T.line_span(F.col("a"), F.col("z")).alias("x")).filter("x is not null").select("l_orderkey", "l_linenumber", F.col("x.start_line").alias("first"), F.col("x.end_line").alias("last"))
)

# ---- the union of signals: nine sources, in their order

_BRANCHES = {
    "docs": "select cast(doc_id as string) as origin, text from documents",
    "conversations": "select concat(cast(conv_id as string), '#', cast(turn as string)) as origin, text from conversations",
    "pages": "select url as origin, html as text from pages",
    "benchmark": "select cast(item_id as string) as origin, text from benchmark",
    "parts": "select p_brand as origin, p_name as text from part",
    "types": "select distinct p_brand as origin, p_type as text from part",
    "customers": "select cast(c_custkey as string) as origin, c_name as text from customer",
    "suppliers": "select cast(s_suppkey as string) as origin, s_name as text from supplier",
    "nations": "select cast(n_regionkey as string) as origin, n_name as text from nation",
}
query("signal_union", " union all ".join(f"select origin, md5(text) as digest, '{k}' as branch, {n} as branch_order from ({q}) x" for n, (k, q) in enumerate(_BRANCHES.items())))(
    lambda t: union_in_order({k: t.sql(q) for k, q in _BRANCHES.items()}).select("origin", F.md5("text").alias("digest"), "branch", "branch_order")
)
_ROUTES = "select p_partkey as pos, concat('/', p_brand, '/', case when p_partkey % 2 = 0 then ':id' else '<key>' end, case when p_partkey % 3 = 0 then '/open' else '' end) as a, concat('/', p_brand, '/{x}', case when p_partkey % 4 = 0 then '/open' when p_partkey % 4 = 1 then '/open/now' else '' end) as b from part"
query("route_cover", f"with r as ({_ROUTES}) select pos, case when pos % 3 = 0 then pos % 4 < 2 else true end as covers from r")(
    lambda t: t.part.select(F.col("p_partkey").alias("pos"), *_routes()).select("pos", T.route_covers(T.route_segments(F.col("a")), T.route_segments(F.col("b"))).alias("covers"))
)


def _routes():
    k = F.col("p_partkey")
    a = F.concat(F.lit("/"), "p_brand", F.lit("/"), F.when(k % 2 == 0, ":id").otherwise("<key>"), F.when(k % 3 == 0, "/open").otherwise(""))
    b = F.concat(F.lit("/"), "p_brand", F.lit("/{x}"), F.when(k % 4 == 0, "/open").when(k % 4 == 1, "/open/now").otherwise(""))
    return a.alias("a"), b.alias("b")
