"""Registry of named queries and, where the semantics allow, their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.plans.fixtures import Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SURVEY_IDS: dict[str, str] = {}


def query(name: str, survey: str, sql: str | None = None):
    """Register a function of `Inputs` as query `name`, covering the listed survey ids."""

    def add(build: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = lambda spark, folder: build(Inputs(spark, folder))
        SURVEY_IDS[name] = survey
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, so sums in another order give the same value."""
    return df.select(*[
        F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ])
