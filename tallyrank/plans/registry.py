"""All registered queries of the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import model_queries as _models
from . import queries as _queries
from . import source_queries as _sources  # noqa: F401  (registers its queries)

FOUND = _queries.FOUND


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _models.bm25_full_eval(spark, sf_dir)
