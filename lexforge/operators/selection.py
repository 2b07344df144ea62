"""Which rows to keep: filters of pages, roles, noise, authorization files, catch-all names, restricted features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions import text as T

# Words that name authorization code, the most telling first; words of catch-all names; what makes an application; roles that aren't mapped.
AUTH_WORDS = "ability abilities permission permissions policy policies authorization authorizations role roles acl guard guards security auth authentication".split()
CATCH_ALL = "misc miscellaneous other others general common shared various".split()
TRIGGERS = "route job consumer webhook".split()
UNMAPPED_ROLES = "infrastructure configuration".split()


def keep(rows: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows that have each wanted value; a filter that is absent (None) passes all."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.filter(F.col(column) == F.lit(value))
    return rows


def keep_rules(rules: DataFrame, features: DataFrame, kind: str | None = None, domain: str | None = None, feature: str | None = None) -> DataFrame:
    """Rules of a kind, domain and feature; a rule of no known feature fails the last two."""
    known = features.select(F.col("slug").alias("feature"), "domain")
    return keep(rules.join(known, "feature", "left").withColumn("feature", F.when(F.col("domain").isNotNull(), F.col("feature"))), {"kind": kind, "domain": domain, "feature": feature})


def with_role(files: DataFrame, roles: DataFrame, role: str, within: DataFrame | None = None) -> DataFrame:
    """Files of a role; with a slice (path), only those in it, and all tests."""
    out = files.join(roles, "path").filter(F.col("role") == role)
    if within is None:
        return out
    inside = within.select("path", F.lit(True).alias("__in")).distinct()
    both = files.join(roles, "path").join(inside, "path", "left")
    return both.filter(((F.col("role") == role) & F.col("__in").isNotNull()) | (F.col("role") == "tests")).drop("__in")


def mapped_sources(files: DataFrame, roles: DataFrame) -> DataFrame:
    """Files that get a context: those without a role of infrastructure or configuration."""
    return files.join(roles.filter(F.col("role").isin(UNMAPPED_ROLES)), "path", "left_anti")


def drop_noise(rules: DataFrame, verdicts: DataFrame, noise: list[str]) -> DataFrame:
    """Rules (n) without those that a verdict (number, class) calls noise; numbers may be written as ``3``, ``R3`` or ``rule 3``."""
    called = verdicts.filter(F.lower(F.trim("class")).isin(noise)).select(F.expr("try_cast(regexp_extract(number, '([0-9]+)', 1) as bigint)").alias("n"), *[c for c in verdicts.columns if c not in ("number", "class")])
    return rules.join(called.distinct(), called.columns, "left_anti")


def is_application(entries: DataFrame, kind: str = "kind") -> DataFrame:
    """One row: whether something triggers the code from outside."""
    return entries.agg(F.coalesce(F.max(F.col(kind).isin(TRIGGERS)), F.lit(False)).alias("application"))


def authorization_files(files: DataFrame, path: str = "path") -> DataFrame:
    """(path, rank): files named by a word of authorization, by the most telling one."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    words = T.identifier_words(stem)
    rank = F.array_min(F.filter(F.transform(F.array(*[F.lit(w) for w in AUTH_WORDS]), lambda w, i: F.when(F.array_contains(words, w), i)), lambda x: x.isNotNull()))
    return files.select(path, rank.alias("rank")).filter("rank is not null")


def is_catch_all(slug: Column) -> Column:
    words = F.filter(F.split(slug, "-"), lambda w: w != "business")
    return (F.size(words) > 0) & F.forall(words, lambda w: w.isin(CATCH_ALL))


def restricted(features: DataFrame, entries: DataFrame, key: str, entry_points: str) -> DataFrame:
    """Features cut to the entry points of a slice; those left without any are gone."""
    held = features.select(key, F.posexplode(entry_points).alias("n", "entry")).join(entries.select("entry").distinct(), "entry", "left_semi")
    kept = held.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "entry"))), lambda x: x["entry"]).alias("__kept"))
    return features.join(kept, key).withColumn(entry_points, F.col("__kept")).drop("__kept")


def expand_files(entries: DataFrame, files: DataFrame, most: int = 60) -> DataFrame:
    """(place, path): the files that ranked entries (rank, path) name, a file as it is, a folder by its files in order; the first entry counts.

    Every file names its own path and all its folders, so entries meet files by an equi-join.
    """
    from pyspark.sql.window import Window

    asked = entries.select("rank", F.regexp_replace(F.regexp_replace(F.trim("path"), r"^(\./)+", ""), "/+$", "").alias("at")).filter("at <> ''")
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    hits = files.select("path", F.explode(up).alias("at")).join(asked, "at").groupBy("path").agg(F.min("rank").alias("rank"))
    top = hits.orderBy("rank", "path").limit(most)  # the cap is the operator's own
    return top.select((F.row_number().over(Window.orderBy("rank", "path"))).alias("place"), "path")


def arranged(rows: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """Rows that an order table (key, place) knows, with their place."""
    return rows.join(order, key)
