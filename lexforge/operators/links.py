"""How records lead to one another: children, claims of domains, cited entry points, reach, usage, neighbours, questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions import text as T


def children(rows: DataFrame, parent: str, key: str, pos: str) -> DataFrame:
    """(parent, children): each parent's keys in order."""
    xs = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(key).alias("k"))))
    return rows.groupBy(parent).agg(F.transform(xs, lambda x: x["k"]).alias("children"))


def domain_entries(entries: DataFrame, resources: DataFrame, paths: DataFrame, routed: DataFrame) -> DataFrame:
    """(domain, id): entry points of a domain, by their resource's normalized name; else by their file, but for those that routes take elsewhere and with those that routes bring in.

    entries: (id, resource, path); resources: (domain, resource); paths: (domain, path);
    routed: (id, source, target), domains that an entry leaves and joins.
    """
    key = T.normalize_name(F.col("resource"))
    named = entries.withColumn("key", key).join(resources.select("domain", key.alias("key")).distinct(), "key").select("domain", "id")
    held = entries.join(paths.select("domain", "path").distinct(), "path").select("domain", "id")
    out = routed.select(F.col("source").alias("domain"), "id")
    come = routed.select(F.col("target").alias("domain"), "id")
    rest = held.join(out, ["domain", "id"], "left_anti").unionByName(come.join(entries.select("id"), "id", "left_semi"))
    unnamed = rest.join(resources.select("domain").distinct(), "domain", "left_anti")
    return named.unionByName(unnamed).distinct()


def support_files(sources: DataFrame, used: list[DataFrame]) -> DataFrame:
    """Source files that no start, slice or entity takes."""
    for rows in used:
        sources = sources.join(rows.select("path"), "path", "left_anti")
    return sources


def known_entries(cited: DataFrame, entries: DataFrame) -> DataFrame:
    """(cited, id): an entry point cited by its tag (E and its place), else its id, else its name where only one has it, as written, else without case; others are left out.

    cited: (cited); entries: (pos, id, name), places from 1.
    """
    c = cited.select(F.col("cited"), F.trim("cited").alias("c")).distinct()
    tag = c.withColumn("pos", F.expr("try_cast(regexp_extract(c, '^[Ee]([0-9]+)$', 1) as bigint)")).join(entries.select("pos", F.col("id").alias("by_tag")), "pos").select("cited", "by_tag")
    by_id = entries.groupBy(F.col("id").alias("c")).agg(F.min("id").alias("by_id"))

    def only(name: Column, to: str, key: str) -> DataFrame:
        return entries.groupBy(name.alias(key)).agg(F.count("*").alias("n"), F.min_by("id", "pos").alias(to)).filter("n = 1").drop("n")

    # Entries that share a name without case may differ in it as written: that is told from the names as written.
    out = c.join(tag, "cited", "left").join(by_id, "c", "left").join(only(F.col("name"), "by_name", "c"), "c", "left").withColumn("low", F.lower("c")).join(only(F.lower("name"), "by_low", "low"), "low", "left")
    return out.select("cited", F.coalesce("by_tag", "by_id", "by_name", "by_low").alias("id")).filter("id is not null")


def without_unreached_api(entries: DataFrame, reached: DataFrame, triggers: list[str], api: str = "public_api") -> DataFrame:
    """Of an application (something triggers it), entries without the public API of files that no trigger reaches; of a library, all."""
    any_ = entries.agg(F.coalesce(F.max(F.col("kind").isin(triggers)), F.lit(False)).alias("__app"))
    seen = reached.select("path", F.lit(True).alias("__seen")).distinct()
    out = entries.join(seen, "path", "left").crossJoin(F.broadcast(any_))
    return out.filter(~F.col("__app") | (F.col("kind") != api) | F.col("__seen").isNotNull()).drop("__app", "__seen")


def concept_usage(entities: DataFrame, cites: DataFrame, rules: DataFrame) -> DataFrame:
    """(entity, use_case): use cases that cite a file of the entity, or that a rule which names it applies to.

    entities: (entity, path); cites: (use_case, path); rules: (entity, use_case).
    """
    return entities.select("entity", "path").distinct().join(cites.select("use_case", "path").distinct(), "path").select("entity", "use_case").unionByName(rules.select("entity", "use_case")).distinct()


def neighbour_rules(rules: DataFrame, wanted: DataFrame) -> DataFrame:
    """(feature, rule): rules of other features that cite a file which a wanted feature's rules cite.

    rules: (rule, feature, path); a pair of a feature and a file is one row before the join.
    """
    mine = rules.select("feature", "path").distinct().join(wanted.select("feature").distinct(), "feature", "left_semi")
    other = rules.select("rule", F.col("feature").alias("of"), "path").distinct()
    return mine.join(other, "path").filter("feature <> of").select("feature", "rule").distinct()


def question_groups(questions: DataFrame, pairs: DataFrame) -> DataFrame:
    """(question, group, hit): a question of a covered reference feature, of one that nothing made covers, or of none (undocumented); whether a source is the expected one or stands under it.

    questions: (question, feature, source); pairs: (reference, generated).
    """
    made = pairs.select(F.col("reference").alias("feature"), F.col("generated")).distinct()
    q = questions.join(made.groupBy("feature").agg(F.count("*").alias("n")), "feature", "left")
    group = F.when(F.col("feature").isNull(), "undocumented").when(F.col("n") > 0, "covered").otherwise("uncovered")
    near = questions.join(made, "feature").select("question", "generated", F.col("source").alias("said"))
    hit = near.filter((F.col("said") == F.col("generated")) | F.startswith("said", F.concat("generated", F.lit("/")))).select("question").distinct().withColumn("hit", F.lit(True))
    return q.select("question", group.alias("group")).join(hit, "question", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
