"""Queries of the licence and secret scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm.common import table
from groundwork.llm.licenses import PHRASES, scan_licenses
from groundwork.llm.secrets import scan_secrets


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    phrases = F.filter("spans", lambda s: s["kind"] == "phrase")
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(phrases, lambda s: s["first_word"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(phrases).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(phrases).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "format")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1_license_scan that the fixed phrases decide."""
    return op1_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6_secret_scan that SQL can count; it has no places of matches."""
    return op6_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES = {f.__name__: f for f in (op1_license_scan, op6_secret_scan, license_base, secret_base)}

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_PLACES = " UNION ALL ".join(f"SELECT doc_id, unnest(list_filter(range(1, len(w) - {len(p.split()) - 2}), lambda i: list_slice(w, i, i + {len(p.split()) - 1}) = {p.split()})) - 1 AS place, '{label}' AS label FROM d" for p, label in PHRASES.items())
_FOUND = lambda pattern, group, least: f"CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '{pattern}', {group}), lambda v: length(v) >= {least})) AS BIGINT)"
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

ORACLE_SQL: dict[str, str] = {
    "license_base": f"WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), p AS ({_PLACES}), g AS (SELECT doc_id, count(*) AS n, min(place) AS a, max(place) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY doc_id) SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN g USING (doc_id)",
    "secret_base": f"SELECT doc_id, {_FOUND(_ASSIGN, 1, 8)} AS n_assign, {_FOUND('AKIA[A-Z0-9]+', 0, 16)} AS n_access, {_FOUND('[0-9a-f]+', 0, 32)} AS n_hex FROM documents",
}
