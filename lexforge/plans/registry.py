"""Where queries are kept: a name, a plan over the tables of a folder, and SQL to hold it against."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_TABLES = "region|nation|customer|supplier|part|orders|lineitem|events|documents|pages|benchmark|labels|conversations"


class Tables:
    """The tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """A select over these tables, in words that Spark and the oracles' engine share; no view is left behind."""
        names = set(re.findall(rf"\b(?:from|join) ({_TABLES})\b", text))
        return self.spark.sql(re.sub(rf"\b(from|join) ({_TABLES})\b", r"\1 {\2}", text), **{n: getattr(self, n) for n in names})


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[Tables], DataFrame]):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return keep
