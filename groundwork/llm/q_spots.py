"""Query of the document fingerprints. Tested against a brute-force version in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm.common import table
from groundwork.llm.spotsigs import fingerprint, jaccard, linked_classes, signatures, with_next


def op5_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, "doc_id", ["text"], {"sigs": signatures(F.col("text"))})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sigs", "next_sigs", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "sigs", "next_sigs", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), signatures(F.col("edited")).alias("edited_sigs"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        F.coalesce(jaccard(F.col("sigs"), F.col("next_sigs")), F.lit(0.0)).alias("near_next"),
    )


def spot_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each document by its fingerprint, and its links: through the partition by set size and pruned likeness."""
    return linked_classes(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (op5_spot_signatures, spot_links)}
ORACLE_SQL: dict[str, str] = {}
