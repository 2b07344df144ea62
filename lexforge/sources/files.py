"""Scans of files and their texts: kinds, test paths, glob rules, sections, phrases, schemas, commits."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Extensions of code, folders and stems of tests.
CODE = "rs ts tsx mts cts js jsx mjs cjs py go java kt kts rb php c h cc cpp hpp cs swift scala sql".split()
TEST_FOLDERS = "tests test spec specs __tests__ e2e".split()
MOST_PHRASES, MOST_PHRASE_CHARS = 30, 160


def read_tree(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """(path, size) of all files under a folder but for ignored globs; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/")) + "/", "").alias("path"), F.col("length").alias("size"))
    for g in ignore or []:
        files = files.filter(~F.col("path").rlike(glob_regex(g)))
    return files


def glob_regex(glob: str) -> str:
    """A path pattern as a regular expression: ** crosses folders, * and ? don't."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def is_test_path(path: Column) -> Column:
    folders = F.transform(F.slice(F.split(F.lower(path), "/"), F.lit(1), F.size(F.split(path, "/")) - 1), lambda x: x)
    stem = F.regexp_replace(F.lower(F.element_at(F.split(path, "/"), -1)), r"\.[^.]*$", "")
    return F.exists(folders, lambda x: x.isin(TEST_FOLDERS)) | stem.rlike(r"(_test|_spec|\.test|\.spec)$") | stem.startswith("test_")


def file_kind(path: Column) -> Column:
    ext = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    never = path.rlike(r"\.gradle\.kts$|(^|/)Package\.swift$|(?i)\.(blade|html|tpl)\.php$")
    return F.when(ext.isin("md", "mdx"), "markdown").when(never, "other").when(ext.isin(CODE), F.when(is_test_path(path), "test").otherwise("source")).otherwise("other")


def promote(files: DataFrame, extensions: list[str], denied: list[str]) -> DataFrame:
    """Other files of asked extensions become source or test, unless the extension is denied."""
    ext = F.lower(F.regexp_extract("path", r"[^/]\.([^./]+)$", 1))
    wanted = [e for e in extensions if e not in denied]
    up = (F.col("kind") == "other") & ext.isin(wanted or [""]) & (ext != "")
    return files.withColumn("kind", F.when(up, F.when(is_test_path(F.col("path")), "test").otherwise("source")).otherwise(F.col("kind")))


def classify(files: DataFrame, rules: list[tuple[str, str, int]], path: str = "path") -> DataFrame:
    """The role of each file by glob rules (glob, role, tier): lower tier, more literal characters, earlier rule."""
    table = [(g, role, tier, -len(re.sub(r"[*?]", "", g)), n) for n, (g, role, tier) in enumerate(rules)]
    hits = [F.when(F.col(path).rlike(glob_regex(g)), F.struct(F.lit(tier).alias("t"), F.lit(lit).alias("l"), F.lit(n).alias("n"), F.lit(role).alias("role"))) for g, role, tier, lit, n in table]
    return files.withColumn("role", F.array_min(F.filter(F.array(*hits), lambda x: x.isNotNull()))["role"])


def tree_overview(files: DataFrame, path: str = "path") -> DataFrame:
    """Files under each folder of the first two levels, and at the root."""
    parts = F.split(path, "/")
    keys = F.array_distinct(F.transform(F.array(F.lit(1), F.lit(2)), lambda k: F.when(F.size(parts) > k, F.array_join(F.slice(parts, F.lit(1), k), "/")).otherwise(F.when(F.size(parts) == 1, F.lit(".")))))
    return files.select(F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("folder")).groupBy("folder").agg(F.count("*").alias("files"))


def sections(docs: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, nth, heading, text): Markdown cut at headings outside fences; empty sections left out.

    The fence is a state machine over a document's lines, so it runs in Arrow batches of documents.
    """

    def cut(text: str) -> Iterator[tuple[str | None, str]]:
        text = text.replace("\r\n", "\n")
        if text.startswith("---\n") and "\n---\n" in text[4:]:
            text = text[4:].split("\n---\n", 1)[1]
        heading, body, fence = None, [], None
        for line in text.split("\n"):
            m = re.match(r"\s*(`{3,}|~{3,})", line)
            if m and fence is None:
                fence = m[1]
            elif m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and set(line.strip()) == {fence[0]}:
                fence = None
            if fence is None and re.match(r"#{1,6} ", line):
                yield heading, "\n".join(body).strip()
                heading, body = line.strip(), []
            else:
                body.append(line)
        yield heading, "\n".join(body).strip()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, n, h.lstrip("#").strip() if h else None, f"{h}\n{t}" if h else t) for p, c in zip(b["p"], b["c"], strict=True) for n, (h, t) in enumerate(x for x in cut(c or "") if x[1])]
            yield pd.DataFrame(rows, columns=["p", "nth", "heading", "text"])

    kind = docs.schema[path].dataType.simpleString()
    one = docs.select(F.col(path).alias("p"), F.col(content).alias("c"))
    return one.mapInPandas(run, f"p {kind}, nth int, heading string, text string").withColumnRenamed("p", path)


def phrases(content: Column) -> Column:
    """Titles of tests: words of ``def test_x`` or the quoted argument of describe, it and the like; distinct, in order."""
    lines = F.transform(F.split(content, "\r?\n"), lambda x: F.trim(x))
    call = r"""^(?:describe|context|feature|scenario|specify|example|test|it)(?:\(\s*| +)["'`]([^"'`]*)"""
    found = F.transform(lines, lambda x: F.trim(F.left(F.trim(F.when(x.startswith("def test_"), F.replace(F.regexp_extract(x, r"^def test_([\p{L}\p{N}_]*)", 1), F.lit("_"), F.lit(" "))).otherwise(F.regexp_extract(x, call, 1))), F.lit(MOST_PHRASE_CHARS))))
    return F.slice(F.array_distinct(F.filter(found, lambda x: x != "")), 1, MOST_PHRASES)


def gherkin_titles(content: Column) -> Column:
    return F.filter(F.transform(F.split(content, "\r?\n"), lambda x: F.trim(x)), lambda x: x.rlike("^(Feature|Rule|Scenario|Scenario Outline|Example):"))


def sql_tables(docs: DataFrame, id_col: str, content: str) -> DataFrame:
    """(id, table_no, name, columns) of CREATE TABLE statements, a column a line.

    Each table's lines are cut out by one pattern, so no state runs over lines.
    """
    block = r"(?im)^\s*create (?:unlogged )?table (?:if not exists )?[^\s(]+[^\n]*(?:\n(?!\s*\)).*)*+"  # possessive: a loop, where the greedy form recurses once a line
    t = docs.select(F.col(id_col), F.posexplode(F.regexp_extract_all(content, F.lit(block), F.lit(0))).alias("table_no", "b"))
    name = F.regexp_replace(F.regexp_extract("b", r"(?i)table (?:if not exists )?([^\s(]+)", 1), r'["`\[\]]', "")
    words = F.transform(F.filter(F.slice(F.split("b", "\n"), F.lit(2), F.size(F.split("b", "\n"))), lambda x: F.trim(x) != ""), lambda x: F.regexp_extract(x, r"^\s*(\S+)", 1))
    keep = F.filter(words, lambda w: ~F.upper(w).isin("CONSTRAINT", "PRIMARY", "FOREIGN", "UNIQUE", "CHECK", "EXCLUDE", "LIKE") & ~w.startswith("--"))
    return t.select(id_col, "table_no", name.alias("name"), F.transform(keep, lambda w: F.regexp_replace(w, r'^["`,\[\]]+|["`,\[\]]+$', "")).alias("columns"))


def migration_words(stem: Column) -> Column:
    """A migration's name without its version."""
    bare = F.regexp_replace(stem, "^[Vv](?=[0-9])", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"^(?:(?=[0-9a-fA-F.]*[0-9])[0-9a-fA-F.]+(?:[_-]+|$))+", ""), "[_-]+", " "))


def migrations(files: DataFrame, stem: str, most: int) -> DataFrame:
    version = F.expr(f"try_cast(regexp_extract({stem}, '^[Vv]?([0-9]+)', 1) as decimal(38,0))")
    rows = files.withColumn("words", migration_words(F.col(stem))).filter("words <> '' and words <> 'init'").withColumn("version", version)
    newest = rows.orderBy(F.col("version").desc_nulls_first(), F.col(stem).desc()).limit(most)
    return newest.withColumn("place", F.row_number().over(Window.orderBy(F.col("version").asc_nulls_last(), stem)))


def conventional_type(subject: Column) -> Column:
    kind = F.regexp_extract(subject, r"^([a-z]+)(?:\([^:]*\))?!?: ", 1)
    return F.when(kind != "", kind)


def commit_subjects(commits: DataFrame, subject: str, author: str, pos: str) -> DataFrame:
    """Subjects worth reading, each once (the newest): bots, merges and dependency bumps dropped; features and fixes first if three in ten are conventional."""
    s, a = F.lower(subject), F.lower(author)
    noise = (s == "") | a.rlike(r"\[bot\]|dependabot|renovate") | s.rlike(r"^(merge pull request|merge branch|merge remote-tracking|update dependency|update dependencies|deps:)") | (s.startswith("bump ") & s.contains(" from ")) | F.coalesce(conventional_type(s).isin("chore", "build") & (s.contains("(deps") | s.contains(": bump ")), F.lit(False))
    key = F.trim(F.regexp_replace(s, r"\s+", " "))
    first = commits.filter(~noise).withColumn("__k", key).groupBy("__k").agg(F.min_by(F.struct(pos, subject), pos).alias("x")).select("x.*")
    kind = conventional_type(F.col(subject))
    share = first.agg((F.count(kind) * 10 >= F.count("*") * 3).alias("conventional"))
    order = F.when(F.col("conventional"), F.when(kind == "feat", 0).when(kind == "fix", 1).otherwise(2)).otherwise(0)
    return first.crossJoin(F.broadcast(share)).withColumn("bucket", order).drop("conventional")


def definitions(files: DataFrame, path: str, content: str) -> DataFrame:
    """(path, line, kind, name, signature) of definitions, found by patterns of the common languages."""
    pattern = r"^\s*(?:(?:pub|public|private|protected|static|async|export|default|abstract|final)\s+)*(def|fn|func|function|class|struct|enum|trait|interface|module)\s+([\p{L}_][\p{L}\p{N}_]*(?:(?:::|\.)[\p{L}\p{N}_]+)*[?!]?)"
    lines = files.select(F.col(path), F.posexplode(F.split(content, "\r?\n")).alias("n", "l")).filter(F.col("l").rlike(pattern))
    return lines.select(path, (F.col("n") + 1).alias("line"), F.regexp_extract("l", pattern, 1).alias("kind"), F.regexp_extract("l", pattern, 2).alias("name"), F.left(F.trim("l"), F.lit(200)).alias("signature"))
