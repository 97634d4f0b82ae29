"""Query of the language identifier. It is tested on held-out accuracy; SQL can't express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from groundwork.llm.common import table
from groundwork.llm.langid import held_out, identify, train_on


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train_on(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language_id": op8_language_id}
ORACLE_SQL: dict[str, str] = {}
