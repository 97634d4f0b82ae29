"""Query of the near-duplicate groups; tested against brute force over all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from groundwork.llm.common import table
from groundwork.llm.near_dedup import near_duplicates


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


QUERIES = {"op2_near_dedup": op2_near_dedup}
ORACLE_SQL: dict[str, str] = {}
