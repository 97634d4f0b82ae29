"""Registered queries over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES: tuple[str, ...] = ("text", "relational", "runs", "more", "checks", "sql", "store", "note_tables", "extensions", "streams", "reports", "bodies")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in importlib.import_module(f"groundwork.plans.{m}").QUERIES.items()}


def all_oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in importlib.import_module(f"groundwork.plans.{m}").ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_queries()["k2_corpus_dedup"](spark, sf_dir)
