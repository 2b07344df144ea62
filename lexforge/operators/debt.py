"""What needs a human: checks of steps, the report of weak sections, the list of debts, rollups of domains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators.ranking import DEBT_WEIGHTS, debt_priority
from lexforge.operators.scoring import LOW, set_apart_reasons

LEAST_ENTITY_CHARS = 4


def step_checks(steps: DataFrame, refs: DataFrame, files: DataFrame, entities: DataFrame) -> DataFrame:
    """(step, check): ungrounded without references; broken where a file or line is missing; doubtful where a named identifier isn't at the cited lines, a named entity isn't in the cited files, or nothing is named; else pass.

    steps: (step, text); refs: (step, path, start_line, end_line); files: (path, content);
    entities: (entity).  An entity is sought by its first word, so steps and entities meet by an
    equi-join; texts meet steps by the paths that they cite.
    """
    lines = F.split("content", "\r?\n")
    count = F.size(lines) - F.when(F.element_at(lines, -1) == "", 1).otherwise(0)
    first = F.coalesce("start_line", "end_line")
    last = F.greatest(F.coalesce("end_line", "start_line"), first)
    cited = F.when(first.isNull(), F.col("content")).otherwise(F.array_join(F.slice(lines, F.greatest(first, F.lit(1)).cast("int"), (last - first + 1).cast("int")), "\n"))
    broken = F.col("content").isNull() | (first < 1) | (first > count)
    seen = refs.join(files, "path", "left").select("step", F.coalesce(broken, F.lit(False)).alias("broken"), F.lower(cited).alias("cited"), F.lower("content").alias("content"))
    per = seen.groupBy("step").agg(F.max("broken").alias("broken"), F.array_join(F.collect_list("cited"), "\n").alias("cited"), F.array_join(F.collect_list("content"), "\n").alias("files"))
    named = T.code_identifiers(F.col("text"))
    lowered = F.lower("text")
    first_word = lambda c: F.regexp_extract(F.lower(c), r"[\p{L}\p{N}]+", 0)
    known = entities.filter(F.length("entity") >= LEAST_ENTITY_CHARS).select(F.lower("entity").alias("entity"), first_word(F.col("entity")).alias("word")).distinct()
    words = steps.select("step", lowered.alias("low"), F.explode(F.array_distinct(F.regexp_extract_all(lowered, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("word"))
    told = words.join(known, "word").filter(F.contains("low", "entity")).groupBy("step").agg(F.collect_set("entity").alias("told"))
    out = steps.select("step", named.alias("named")).join(per, "step", "left").join(told, "step", "left")
    astray = F.exists("named", lambda x: ~F.contains(F.col("cited"), F.lower(x)))
    foreign = F.coalesce(F.exists("told", lambda x: ~F.contains(F.col("files"), x)), F.lit(False))
    nothing = (F.size("named") == 0) & F.col("told").isNull()
    check = F.when(F.col("broken").isNull(), "ungrounded").when(F.col("broken"), "broken").when(astray | foreign | nothing, "doubtful").otherwise("pass")
    return out.select("step", check.alias("check"))


def report(features: DataFrame, use_cases: DataFrame, uncategorized: DataFrame) -> DataFrame:
    """(kind, id, domain, feature, score, reasons): every finding of the debt report.

    features: (slug, domain, back_office, confidence); use_cases: (slug, feature, confidence,
    business, narrative_check); uncategorized: (path).
    """
    of = features.select(F.col("slug").alias("feature"), "domain", "back_office")
    cases = use_cases.withColumnRenamed("slug", "id").join(of, "feature", "left")
    none = F.array().cast("array<string>")

    def found(rows: DataFrame, kind: str, score: Column = F.lit(None), reasons: Column = none) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), "id", "domain", "feature", score.cast("double").alias("score"), reasons.alias("reasons"))

    reasons = set_apart_reasons(F.coalesce("back_office", F.lit(False)), F.col("business"), F.col("confidence"))
    alone = features.filter(F.col("confidence") < LOW).join(use_cases.select(F.col("feature").alias("slug")), "slug", "left_anti")
    lone = features.join(use_cases.select(F.col("feature").alias("slug")), "slug", "left_anti")
    parts = [
        found(cases.filter(F.col("confidence") < LOW), "weak", F.col("confidence")),
        found(alone.select(F.col("slug").alias("id"), "domain", F.col("slug").alias("feature"), "confidence"), "weak", F.col("confidence")),
        found(cases.filter("confidence is null"), "not_scored"),
        found(cases.filter(F.col("business") < LOW), "technical", F.col("business")),
        found(cases.filter("narrative_check <= 0"), "unbacked", F.col("narrative_check")),
        found(cases.withColumn("why", reasons).filter(F.size("why") > 0), "set_apart", reasons=F.col("why")),
        found(lone.select(F.col("slug").alias("id"), "domain", F.col("slug").alias("feature")), "featureless"),
        found(uncategorized.select(F.col("path").alias("id"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("feature")), "uncategorized"),
    ]
    return reduce(DataFrame.unionByName, parts)


def weak_order(weak: DataFrame) -> DataFrame:
    """Weak sections within each domain, the worst first, then by section (a feature before its use cases)."""
    from pyspark.sql.window import Window

    return weak.withColumn("place", F.row_number().over(Window.partitionBy("domain").orderBy("score", "feature", "id")))


def folder_of(entry: Column) -> Column:
    """The folder of a path or of an entry point ``<file>#<name>``; a dot for the root or no file."""
    left = F.substring_index(entry, "#", 1)
    file = F.when(F.contains(entry, F.lit("#")) & ~left.rlike("[./]"), "").otherwise(left)
    folder = F.regexp_extract(file, "^(.*)/[^/]*$", 1)
    return F.when(folder == "", ".").otherwise(folder)


def code_debts(parts: dict[str, DataFrame], entry: str = "entry") -> DataFrame:
    """(kind, id, entries): code that no doc covers, an item a kind and folder."""
    rows = reduce(DataFrame.unionByName, [d.select(F.lit(kind).alias("kind"), F.col(entry).alias("entry")) for kind, d in parts.items()])
    return rows.groupBy("kind", folder_of(F.col("entry")).alias("id")).agg(F.count("*").alias("entries"))


def full_list(judged: DataFrame, others: DataFrame, validated: DataFrame, commits: DataFrame) -> DataFrame:
    """The whole list of debts with priorities.

    judged: (kind, id, score, entry_points) of the kinds that judge a section, which a validation
    removes; others: the same of all other kinds; validated: (id); commits: (id, commits).  Unscored
    use cases are no debt where none at all is scored.
    """
    scored = judged.agg((F.count_if(F.col("kind") != "not_scored") > 0).alias("__any"))
    kept = judged.join(validated, "id", "left_anti").crossJoin(F.broadcast(scored)).filter(F.col("__any") | (F.col("kind") != "not_scored")).drop("__any")
    both = kept.unionByName(others).join(commits, "id", "left")
    order = list(DEBT_WEIGHTS)
    weight = F.element_at(F.create_map(*[F.lit(x) for k, w in DEBT_WEIGHTS.items() for x in (k, w)]), F.col("kind"))
    n = F.element_at(F.create_map(*[F.lit(x) for k in order for x in (k, order.index(k))]), F.col("kind"))
    score = F.when(F.col("kind") == "unbacked_narrative", None).otherwise(F.col("score"))  # always 0: says nothing
    priority = debt_priority(weight, score, F.coalesce("commits", F.lit(0)), F.col("entry_points"))
    return both.select("kind", n.alias("kind_order"), "id", F.round(priority, 6).alias("priority"))


def domain_debts(features: DataFrame, use_cases: DataFrame) -> DataFrame:
    """(domain, features, use_cases, confidence): figures of each domain with features."""
    cases = use_cases.groupBy(F.col("feature").alias("slug")).agg(F.count("*").alias("n"))
    return features.join(cases, "slug", "left").groupBy("domain").agg(F.count("*").alias("features"), F.coalesce(F.sum("n"), F.lit(0)).alias("use_cases"), F.round(F.avg("confidence"), 6).alias("confidence"))


def domain_rows(domains: DataFrame, features: DataFrame, use_cases: DataFrame, stale: DataFrame, reviews: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows of the page of domains: features, use cases, whether a file that they cite is stale, the review's state, whether a human edited them.

    stale: (use_case); reviews: (slug, status); edits: (slug).
    """
    per = use_cases.join(stale.select(F.col("use_case").alias("slug"), F.lit(True).alias("old")).distinct(), "slug", "left")
    per = per.groupBy("feature").agg(F.count("*").alias("n"), F.max(F.coalesce("old", F.lit(False))).alias("old"))
    mine = features.join(per.withColumnRenamed("feature", "slug"), "slug", "left").groupBy("domain").agg(F.count("*").alias("features"), F.sum(F.coalesce("n", F.lit(0))).alias("use_cases"), F.max(F.coalesce("old", F.lit(False))).alias("stale"))
    out = domains.select("slug", "name").join(mine.withColumnRenamed("domain", "slug"), "slug", "left").join(reviews.select("slug", "status"), "slug", "left")
    out = out.join(edits.select("slug", F.lit(True).alias("edited")).distinct(), "slug", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    false = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return out.select("slug", "name", zero("features"), zero("use_cases"), false("stale"), F.coalesce("status", F.lit("to_review")).alias("badge"), false("edited"))


def set_aside(features: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    """Features that stay in the docs, and those that a flag takes to the side table."""
    return features.filter(~F.coalesce(flag, F.lit(False))), features.filter(F.coalesce(flag, F.lit(False)))
