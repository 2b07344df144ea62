"""Artifacts and what runs keep: saving, idempotent writes, snapshots, pages, batches of reads, retention, read views by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexforge.operators.passes import changed_snapshot


def save_artifact(rows: DataFrame, path: str) -> None:
    """The rows of an artifact, in place of those that were there."""
    rows.write.mode("overwrite").parquet(path)


def apply_plan(plan: DataFrame, pages: DataFrame, path: str, status: str = "status") -> bool:
    """Writes the pages unless the plan changes none; whether it has written.  A run that changes nothing leaves the files alone."""
    if plan.filter(F.col(status) != "unchanged").isEmpty():
        return False
    save_artifact(pages, path)
    return True


def save_snapshot(spark: SparkSession, path: str, rows: DataFrame, run: int) -> bool:
    """Appends a run's snapshot, unless it equals the newest saved one; whether it has.  A run's folder is replaced, so a retry adds nothing."""
    try:
        saved = spark.read.parquet(path)
        newest = saved.agg(F.max("run")).first()[0]
        old = saved.filter(F.col("run") == newest).drop("run")
        if newest is not None and newest != run and not changed_snapshot(old, rows):
            return False
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    rows.write.mode("overwrite").parquet(f"{path}/run={run}")
    return True


def incoming(produced: DataFrame, saved: DataFrame, key: str) -> DataFrame:
    """Retention that keeps: the rows produced now, and the saved ones of keys that weren't read."""
    return produced.unionByName(saved.join(produced.select(key).distinct(), key, "left_anti"))


def read_state(parts: DataFrame, answers: DataFrame, file: str = "file", part: str = "part") -> DataFrame:
    """(file, parts, answered, read): a file is read once every part of it has an answer."""
    a = answers.select(file, part).distinct().withColumn("__a", F.lit(1))
    g = parts.join(a, [file, part], "left").groupBy(file).agg(F.count("*").alias("parts"), F.count("__a").alias("answered"))
    return g.withColumn("read", F.col("parts") == F.col("answered"))


def in_order(results: DataFrame, inputs: DataFrame, key: str, pos: str) -> DataFrame:
    """Results with the place of their input: units may be worked on in any order, the output's is the inputs'."""
    return results.join(inputs.select(key, pos), key)


def live_model(generated: DataFrame, edits: DataFrame, key: str, version: str) -> DataFrame:
    """What is served: generated rows, each with the newest edit's text, and whether one was applied."""
    newest = edits.groupBy(key).agg(F.max_by("text", version).alias("__text"))
    out = generated.join(newest, key, "left")
    return out.withColumn("edited", F.coalesce(F.trim("__text") != "", F.lit(False))).withColumn("text", F.when(F.col("edited"), F.col("__text")).otherwise(F.col("text"))).drop("__text")


def page(title: Column, intro: Column, rows: Column, line) -> Column:
    """A Markdown page: a heading, an introduction, a list with a line a row; blocks that are blank are left out."""
    body = F.array_join(F.transform(rows, line), "\n")
    return F.array_join(F.filter(F.array(F.concat(F.lit("# "), title), intro, body), lambda x: F.coalesce(F.trim(x), F.lit("")) != ""), "\n\n")


def domain_pages(domains: DataFrame, features: DataFrame) -> DataFrame:
    """(path, text): a page a domain with its features in order, and the index of all.

    domains: (slug, name, description, pos); features: (domain, slug, name, pos).
    """
    xs = F.array_sort(F.collect_list(F.struct("pos", "slug", "name")))
    held = features.groupBy(F.col("domain").alias("slug")).agg(xs.alias("xs"))
    none = F.array().cast(f"array<struct<pos:{features.schema['pos'].dataType.simpleString()},slug:string,name:string>>")
    link = lambda x: F.concat(F.lit("- ["), x["name"], F.lit("]("), x["slug"], F.lit(".md)"))
    each = domains.join(held, "slug", "left").select(F.concat("slug", F.lit(".md")).alias("path"), page(F.col("name"), F.col("description"), F.coalesce("xs", none), link).alias("text"))
    index = domains.select(F.lit("index.md").alias("path"), "pos", "slug", "name").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "slug", "name"))).alias("xs"))
    return each.unionByName(index.select("path", page(F.lit("Domains"), F.lit(None).cast("string"), F.col("xs"), link).alias("text")))


def record_view(records: DataFrame, asked: DataFrame, children: DataFrame, key: str = "slug", kind: str = "domain") -> DataFrame:
    """(asked, found, name, children, known): records by key with their children in order; for an unknown key the keys that are known, in order (``known`` is null otherwise).

    records: (key, name, pos), few enough to be listed; children: (parent, child, pos).
    """
    held = children.groupBy(F.col("parent").alias(key)).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "child"))), lambda x: x["child"]).alias("children"))
    every = records.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", key))), lambda x: x[key]).alias("__known"))
    out = asked.select(F.col(key)).distinct().join(records.select(key, "name"), key, "left").join(held, key, "left").crossJoin(F.broadcast(every))
    found = F.col("name").isNotNull()
    return out.select(F.col(key).alias("asked"), F.when(found, kind).alias("found"), "name", F.when(found, F.coalesce("children", F.array().cast("array<string>"))).alias("children"), F.when(~found, F.col("__known")).alias("known"))


def suggestions(domains: DataFrame, purpose: str, most: int = 3) -> DataFrame:
    """(place, question): the question on the purpose, then one on each of the first domains."""
    first = domains.orderBy("pos").limit(most)  # the cap is the operator's own
    asked = first.select(F.row_number().over(Window.orderBy("pos")).alias("place"), F.concat(F.lit("What does "), "name", F.lit(" do?")).alias("question"))
    return domains.sparkSession.createDataFrame([(0, purpose)], "place int, question string").unionByName(asked)


def evidence_problems(evidence: DataFrame, files: DataFrame, headings: DataFrame) -> DataFrame:
    """(id, problem): cited paths that don't exist, and headings that their document lacks.  evidence: (id, path, heading)."""
    lost = evidence.join(files.select("path"), "path", "left_anti").select("id", F.lit("no file").alias("problem"))
    there = evidence.join(files.select("path"), "path", "left_semi").filter("heading is not null")
    return lost.unionByName(there.join(headings.select("path", "heading"), ["path", "heading"], "left_anti").select("id", F.lit("no heading").alias("problem")))


def question_problems(questions: DataFrame, features: DataFrame, words: DataFrame) -> DataFrame:
    """(id, problem): questions on features that don't exist, and terms said to be absent that some file has.

    questions: (id, feature, absent array<string>); words: (word), lower case.
    """
    lost = questions.filter("feature is not null").join(features.select("feature"), "feature", "left_anti").select("id", F.lit("no feature").alias("problem"))
    terms = questions.select("id", F.explode("absent").alias("term")).select("id", F.lower("term").alias("word"))
    return lost.unionByName(terms.join(words.select("word").distinct(), "word", "left_semi").select("id", F.lit("term is there").alias("problem")).distinct())


def resolved_claims(claims: DataFrame, signals: DataFrame) -> DataFrame:
    """(claim, origins): the origins of the signals that a claim cites, each once in order; unknown ids are dropped, and claims that cite none that is known.

    claims: (claim, nth, id); signals: (id, origin).
    """
    met = claims.join(signals.select("id", "origin"), "id").groupBy("claim", "origin").agg(F.min("nth").alias("nth"))
    return met.groupBy("claim").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "origin"))), lambda x: x["origin"]).alias("origins"))


def attributed(answers: DataFrame, batch: DataFrame) -> DataFrame:
    """(file, name, pos): what an answer names, with the file of its part; parts that weren't in the batch are dropped, and of a file's equal names the first counts.

    answers: (part, name, pos); batch: (part, file).
    """
    return answers.join(batch, "part").groupBy("file", "name").agg(F.min("pos").alias("pos"))


def unaudited(pairs: DataFrame, audited: DataFrame) -> DataFrame:
    """(kind, proposed, unaudited): pairs that a judge proposes, and those that nobody has looked at."""
    seen = audited.select("kind", "generated", "reference").distinct().withColumn("__s", F.lit(1))
    return pairs.distinct().join(seen, ["kind", "generated", "reference"], "left").groupBy("kind").agg(F.count("*").alias("proposed"), F.count_if(F.col("__s").isNull()).alias("unaudited"))


def answer_sources(answers: DataFrame, entries: DataFrame) -> DataFrame:
    """(question, source): cited sources that exist, each once.  answers: (question, sources array<string>); entries: (id)."""
    cited = answers.select("question", F.explode("sources").alias("source")).distinct()
    return cited.join(entries.select(F.col("id").alias("source")), "source", "left_semi").select("question", "source")


def tree_evidence(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(path, files, sources): how many files stand under each path that an answer ranks, and how many of them are code."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    under = files.select("kind", F.explode(up).alias("path")).join(entries.select("path").distinct(), "path", "left_semi").groupBy("path").agg(F.count("*").alias("files"), F.count_if(F.col("kind") == "source").alias("sources"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return entries.select("path").distinct().join(under, "path", "left").select("path", zero("files"), zero("sources"))


def without_invented_humans(steps: DataFrame, entries: DataFrame, system: str = "System") -> DataFrame:
    """Steps of use cases that no person starts (none of their entry points is a route or a page) get the system in place of human actors.

    steps: (use_case, nth, actor, human); entries: (use_case, kind).
    """
    started = entries.groupBy("use_case").agg(F.max(F.col("kind").isin("route", "page")).alias("__person"))
    out = steps.join(started, "use_case", "left")
    invented = F.col("human") & ~F.coalesce("__person", F.lit(True))
    return out.withColumn("actor", F.when(invented, F.lit(system)).otherwise(F.col("actor"))).withColumn("human", F.col("human") & ~invented).drop("__person")


def union_in_order(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of named branches with ``branch`` and its order."""
    return reduce(DataFrame.unionByName, [d.withColumn("branch", F.lit(k)).withColumn("branch_order", F.lit(n)) for n, (k, d) in enumerate(parts.items())])
