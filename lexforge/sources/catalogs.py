"""Scans of documents, catalogs, schemas and artifacts: what is read, in which format, and what may be read."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from lexforge.sources.files import glob_regex

# Language codes that a catalog's path may name; rows of a schema block that are no columns.
LANGUAGES = "ar bg cs da de el en es et fa fi fr he hi hr hu id it ja ko lt lv nb nl no pl pt ro ru sk sl sr sv th tr uk vi zh".split()
NOT_COLUMNS = "index check_constraint foreign_key unique_constraint exclusion_constraint".split()
LATEST = 1


def ignore_regex(pattern: str) -> str:
    """A line of an ignore file as a regular expression on paths: a slash inside ties it to the root, one at the end means folders."""
    body = pattern.strip("/")
    tied = "/" in pattern.rstrip("/")
    inner = glob_regex(body)[1:-1]
    return f"^{'' if tied else '(?:.*/)?'}{inner}{'/.*' if pattern.endswith('/') else '(?:/.*)?'}$"


def without_ignored(files: DataFrame, rules: list[str], path: str = "path") -> DataFrame:
    """Files that the last matching rule doesn't ignore; ``!`` takes a file back, blank lines and comments are no rules."""
    hit = F.lit(False)
    for rule in rules:
        rule = rule.strip()
        if rule and not rule.startswith("#"):
            hit = F.when(F.col(path).rlike(ignore_regex(rule.lstrip("!"))), F.lit(not rule.startswith("!"))).otherwise(hit)
    return files.filter(~hit)


def existing_docs(files: DataFrame, wanted: list[str], path: str = "path") -> DataFrame:
    """Markdown files that are named, or stand under a named folder, each once."""
    hit = F.lit(False)
    for w in wanted:
        at = re.sub(r"^(\./)+", "", w).rstrip("/")
        hit = hit | (F.col(path) == at) | F.startswith(path, F.lit(at + "/")) if at not in ("", ".") else F.lit(True)
    return files.filter(hit & F.lower(path).rlike(r"\.mdx?$")).dropDuplicates([path])


def root_markdown(files: DataFrame, path: str = "path") -> DataFrame:
    return files.filter(~F.contains(path, F.lit("/")) & F.lower(path).rlike(r"\.mdx?$"))


def text_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of text files under a folder."""
    read = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(root)
    return read.select(F.regexp_replace(F.col("_metadata.file_path"), "^.*?" + re.escape(root.rstrip("/")) + "/", "").alias("path"), F.col("value").alias("content"))


def active_record_tables(docs: DataFrame, key: str, content: str) -> DataFrame:
    """(key, table_no, name, columns) of ``create_table`` blocks, a column a line; indexes and constraints aren't columns."""
    block = r"(?m)^\s*create_table\s+[\"':][^\n]*(?:\n(?!\s*end\s*$).*)*+"  # possessive: a loop, where the greedy form recurses once a line
    t = docs.select(key, F.posexplode(F.regexp_extract_all(content, F.lit(block), F.lit(0))).alias("table_no", "b"))
    lines = F.filter(F.split("b", "\n"), lambda x: x.rlike(r"^\s*t\.[a-z_]+\s"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^\s*t\.([a-z_]+)", 1).alias("kind"), F.regexp_extract(x, r"^\s*t\.[a-z_]+\s+[\"':]([A-Za-z0-9_]+)", 1).alias("column")))
    kept = F.filter(pairs, lambda p: ~p["kind"].isin(NOT_COLUMNS) & (p["column"] != ""))
    return t.select(key, "table_no", F.regexp_extract("b", r"create_table\s+[\"':]([A-Za-z0-9_.]+)", 1).alias("name"), F.transform(kept, lambda p: p["column"]).alias("columns"))


def properties_entries(files: DataFrame, path: str, content: str) -> DataFrame:
    """(path, key, text) of ``key = text`` and ``key: text`` lines; comments and lines without text are left out."""
    lines = files.select(path, F.explode(F.split(content, "\r?\n")).alias("l"))
    pattern = r"^\s*([^#!\s=:][^=:]*?)\s*[=:]\s*(.*?)\s*$"
    return lines.select(path, F.regexp_extract("l", pattern, 1).alias("key"), F.regexp_extract("l", pattern, 2).alias("text")).filter("key <> '' and text <> ''")


def gettext_entries(files: DataFrame, path: str, content: str) -> DataFrame:
    """(path, key, text) of one-line ``msgid`` and ``msgstr`` pairs; the header (an empty id) is left out, a pair without a translation shows its id."""
    pair = r'(?m)^msgid "((?:[^"\\]|\\.)*)"\s*\nmsgstr "((?:[^"\\]|\\.)*)"'
    found = files.select(path, F.explode(F.regexp_extract_all(content, F.lit(pair), F.lit(0))).alias("p"))
    key, text = F.regexp_extract("p", pair, 1), F.regexp_extract("p", pair, 2)
    return found.select(path, key.alias("key"), F.when(text == "", key).otherwise(text).alias("text")).filter("key <> ''")


def yaml_entries(files: DataFrame, path: str, content: str) -> DataFrame:
    """(path, key, text) of nested mappings of plain and quoted scalars, by dotted keys.

    A line's parents are the lines before it that are indented less than all between: a fold over a
    file's lines with the open keys as its state.  Lists, comments and blank lines are passed over.
    """
    line = r"^( *)([^\s#:'\"-][^:]*|'[^']*'|\"[^\"]*\"):(?: +(.*?))? *$"
    lines = F.filter(F.split(content, "\r?\n"), lambda x: x.rlike(line))
    parsed = F.transform(lines, lambda x: F.struct(F.length(F.regexp_extract(x, line, 1)).alias("depth"), F.regexp_replace(F.trim(F.regexp_extract(x, line, 2)), "^['\"]|['\"]$", "").alias("key"), F.regexp_extract(x, line, 3).alias("text")))
    open_, out = "array<struct<depth:int,key:string>>", "array<struct<key:string,text:string>>"
    start = F.struct(F.array().cast(open_).alias("open"), F.array().cast(out).alias("out"))

    def step(a: Column, x: Column) -> Column:
        above = F.filter(a["open"], lambda o: o["depth"] < x["depth"])
        name = F.array_join(F.concat(F.transform(above, lambda o: o["key"]), F.array(x["key"])), ".")
        text = F.regexp_replace(F.trim(F.regexp_replace(x["text"], r"\s+#.*$", "")), "^['\"]|['\"]$", "")
        said = (text != "") & ~x["text"].rlike(r"^([|>][+-]?|&\S+|\*\S+)\s*$")
        more = F.when(said, F.array(F.struct(name.alias("key"), text.alias("text")))).otherwise(F.array().cast(out))
        return F.struct(F.concat(above, F.array(F.struct(x["depth"].alias("depth"), x["key"].alias("key")))).alias("open"), F.concat(a["out"], more).alias("out"))

    return files.select(path, F.inline(F.aggregate(parsed, start, step, lambda a: a["out"])))


def catalog_language(path: Column) -> Column:
    """The language that a catalog's path names, in its file name or a folder; null if none."""
    parts = F.filter(F.split(F.regexp_replace(F.lower(path), r"\.[^./]*$", ""), r"[/._-]"), lambda p: p.isin(LANGUAGES))
    return F.when(F.size(parts) > 0, F.element_at(parts, -1))


def one_language(entries: DataFrame, path: str = "path") -> DataFrame:
    """Entries of one language (English if any, else the one of most files, the last by name of equals) and of files that name none."""
    lang = entries.withColumn("__lang", catalog_language(F.col(path)))
    n = lang.filter("__lang is not null").groupBy(F.col("__lang").alias("l")).agg(F.count_distinct(path).alias("n"))
    pick = n.agg(F.max_by("l", F.struct((F.col("l") == "en").cast("int"), "n", "l")).alias("__pick"))
    return lang.crossJoin(F.broadcast(pick)).filter("__lang is null or __lang = __pick").drop("__lang", "__pick")


def sniff_format(path: Column, content: Column) -> Column:
    """Which source a file is, by its path and text: schema, migration or catalog formats; null if none."""
    low = F.lower(path)
    return (
        F.when(low.rlike(r"(^|/)db/schema\.rb$"), "schema/active_record")
        .when(low.rlike(r"\.sql$") & content.rlike(r"(?im)^\s*create table"), F.when(low.rlike(r"(^|/)migrat[a-z]*/"), "migration/sql").otherwise("schema/sql"))
        .when(low.rlike(r"(^|/)(db/migrate|migrations?|versions)/[^/]*[0-9]{3,}[^/]*\.(rb|py|js|ts|php|sql)$"), "migration/code")
        .when(low.rlike(r"(^|/)(locales?|i18n|translations?|lang)/.*\.ya?ml$"), "catalog/yaml")
        .when(low.rlike(r"(^|/)(locales?|i18n|translations?|lang)/.*\.json$"), "catalog/json")
        .when(low.rlike(r"(^|/)messages[^/]*\.properties$"), "catalog/properties")
        .when(low.rlike(r"\.po$"), "catalog/gettext")
    )


def dry_run(files: DataFrame, entries: DataFrame, rules: list[tuple[str, str]], path: str = "path") -> DataFrame:
    """(rule, glob, files, usable): how many files each rule (kind, glob) matches, and how many of these give an entry."""
    used = entries.select(path, F.lit(True).alias("used")).distinct()
    hits = F.array(*[F.when(F.col(path).rlike(glob_regex(g)), F.lit(n)) for n, (_, g) in enumerate(rules)])
    matched = files.select(path, F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("n")).join(used, path, "left")
    per = matched.groupBy("n").agg(F.count("*").alias("files"), F.count("used").alias("usable"))
    table = files.sparkSession.createDataFrame([(n, k, g) for n, (k, g) in enumerate(rules)], "n int, rule string, glob string")
    return table.join(per, "n", "left").select("rule", "glob", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("usable", F.lit(0)).alias("usable"))


def usable_rules(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules that matched files and gave entries, and the others."""
    good = (F.col("files") > 0) & (F.col("usable") > 0)
    return checked.filter(good), checked.filter(~good)


def prefix(content: Column, n: int) -> Column:
    """The first n bytes as text; a character that they cut is left out, bytes that are no text are replaced."""
    raw = content.cast("binary")
    head = F.make_valid_utf8(F.substring(raw, 1, n).cast("string"))
    return F.when(F.octet_length(raw) > n, F.regexp_replace(head, "\ufffd+$", "")).otherwise(head)


def readable(cited: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Cited paths that a walk has found and that don't leave the root."""
    inside = cited.filter(~F.col(path).rlike(r"(^|/)\.\.(/|$)") & ~F.startswith(path, F.lit("/")))
    return inside.join(files.select(path), path, "left_semi")


def load_artifact(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a JSON artifact by its schema; unreadable records are dropped, missing fields are null, a missing file is an empty table."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def run_order(name: Column) -> tuple[Column, Column]:
    """(date, number) of a run's file, ``2024-05-01.json`` or ``2024-05-01-2.json``: its order in the series."""
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"\.json$", "")
    number = F.regexp_extract(stem, r"^\d{4}-\d{2}-\d{2}-(\d+)$", 1)
    return F.regexp_extract(stem, r"^(\d{4}-\d{2}-\d{2})", 1), F.when(number == "", F.lit(1)).otherwise(number.try_cast("int"))


def snapshots(rows: DataFrame, name: str, version: str, latest: int = LATEST) -> DataFrame:
    """Runs in order, ``run`` counting from 1: files with a date, of a version that is known."""
    day, n = run_order(F.col(name))
    known = rows.withColumn("__day", day).withColumn("__n", n).filter((F.col("__day") != "") & (F.coalesce(version, F.lit(latest)) <= latest))
    return known.withColumn("run", F.row_number().over(Window.orderBy("__day", "__n", name))).drop("__day", "__n")  # a row a run


def series(rows: DataFrame, name: str) -> DataFrame:
    """Rows of ``<folder>/<series>/<run>.json`` with their series and run's place; folders that begin with a dot are left out."""
    parts = F.split(name, "/")
    named = rows.withColumn("series", F.element_at(parts, -2)).filter(~F.startswith("series", F.lit(".")) & F.endswith(name, F.lit(".json")))
    return named.withColumn("place", F.row_number().over(Window.partitionBy("series").orderBy(F.element_at(parts, -1))))
