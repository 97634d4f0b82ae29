"""Queries written in SQL, with the library's registered functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from groundwork import sql
from groundwork.plans import checks, text
from groundwork.plans.derive import table


def sql_numbers(spark: SparkSession, d: str) -> DataFrame:
    sql.register(spark)
    return spark.sql("SELECT doc_id, n.ord, n.raw, CAST(n.value AS DOUBLE) AS value, n.kind, n.scale, n.fuzzy FROM {docs}, LATERAL number_tokens(text) AS n", docs=table(spark, d, "documents"))


def sql_text(spark: SparkSession, d: str) -> DataFrame:
    sql.register(spark)
    return spark.sql(
        "SELECT doc_id, text_normalize(text) AS norm, sha2(CAST(text_fold(text) AS BINARY), 256) AS folded_sha256, content_fingerprint(lang, NULL, NULL, NULL, text) AS content_hash FROM {docs}",
        docs=table(spark, d, "documents"),
    )


QUERIES = {f.__name__: f for f in (sql_numbers, sql_text)}

ORACLE_SQL = {
    "sql_numbers": checks.ORACLE_SQL["g2_numbers"],
    "sql_text": f"SELECT doc_id, {text._NORM_TEXT} AS norm, sha256(replace(lower(text), 'ß', 'ss')) AS folded_sha256, {text._HASH} AS content_hash FROM documents",
}
