"""Scores and rule-based verdicts: business language, confidence, reconciliation, debt."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators.ranking import DEBT_WEIGHTS, debt_priority

BUSINESS, CONFIDENT, LOW = 0.8, 0.6, 0.5


def business_language(narrative: Column, names: list[str], has_trigger: Column, actors_known: bool = True) -> Column:
    """1 less 0.15 for each code word (0.6 at most), 0.3 without a known name, 0.2 without a trigger; 0 without a narrative."""
    leaks = F.least(F.size(T.code_leaks(narrative, names)) * 0.15, F.lit(0.6))
    named = reduce(Column.__or__, [T.mentions(narrative, F.lit(n)) for n in names], F.lit(not names))
    score = 1 - leaks - F.when(named, 0.0).otherwise(0.3) - F.when(has_trigger | F.lit(not actors_known), 0.0).otherwise(0.2)
    return F.when(F.coalesce(F.trim(narrative), F.lit("")) == "", 0.0).otherwise(F.greatest(F.lit(0.0), score))


def set_apart_reasons(back_office: Column, business: Column, confidence: Column) -> Column:
    """Why a section is set apart; unknown scores are no reason."""
    reasons = F.array(F.when(back_office, F.lit("back office")), F.when(business < BUSINESS, F.lit("technical language")), F.when(confidence < CONFIDENT, F.lit("low confidence")))
    return F.filter(reasons, lambda x: x.isNotNull())


def rule_confidence(tested: Column, documented: Column) -> Column:
    return F.when(tested & documented, 0.85).when(tested | documented, 0.7).otherwise(0.4)


def reconcile(items: DataFrame, answers: DataFrame, key: str, answer: str) -> DataFrame:
    """Verdict of each item over its sections' answers: a contradiction before cover before unrelated; matched if none is judged; undocumented without sections."""
    a = answers.groupBy(key).agg(F.count("*").alias("sections"), F.count(answer).alias("judged"), F.max(F.col(answer) == "contradicts").alias("against"), F.max(F.col(answer) == "covers").alias("covered"))
    v = F.when(F.col("sections").isNull(), "undocumented").when(F.col("judged") < F.col("sections"), "matched").when(F.col("against"), "contradicted").when(F.col("covered"), "documented").otherwise("undocumented")
    return items.join(a, key, "left").select(*items.columns, v.alias("verdict"))


def step_value(kind: Column, verdict: Column) -> Column:
    v = F.when(verdict == "yes", 1.0).when(verdict == "partly", 0.5).when(verdict == "no", 0.0)
    return F.when(kind == "pass", 1.0).when(kind == "ungrounded", 0.25).when(kind == "broken", 0.0).otherwise(v)


def debt_list(branches: dict[str, DataFrame], validated: DataFrame, judging: list[str]) -> DataFrame:
    """One list of all debts (id, score, commits, entry_points a branch): validated sections leave the judging kinds; sorted by priority, kind, id."""
    order = list(DEBT_WEIGHTS)
    parts = []
    for kind, rows in branches.items():
        kept = rows.join(validated, "id", "left_anti") if kind in judging else rows
        parts.append(kept.select("id", "score", "commits", "entry_points", F.lit(kind).alias("kind"), F.lit(DEBT_WEIGHTS[kind]).alias("weight"), F.lit(order.index(kind)).alias("kind_order")))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("priority", F.round(debt_priority(F.col("weight"), F.col("score"), F.col("commits"), F.col("entry_points")), 6))
