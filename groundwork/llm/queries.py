"""The queries opN_<name>: each applies one operator to its whole table and derives the columns that were asked for."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules with a QUERIES dict of name to function(spark, sf_dir), and an ORACLE_SQL dict.
MODULES = ("q_tokens", "q_scans", "q_langid", "q_decontam", "q_near", "q_spots", "q_chat", "q_html", "q_periodic", "q_topk", "q_align")


#: Imported with this module, so that a library that one of them needs is missed here.
_LOADED = [importlib.import_module(f"groundwork.llm.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _LOADED for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _LOADED for k, s in m.ORACLE_SQL.items()}
