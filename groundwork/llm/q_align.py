"""Query of the cross-tokenizer alignment. SQL can't express it; a test holds it against all pairs of whole texts' tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm.align import aligned, with_link_counts
from groundwork.llm.common import table


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as g:
        rows = aligned(table(spark, sf_dir, "documents"), f.read(), g.read())
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return with_link_counts(rows.withColumn("groups", digest).withColumnRenamed("groups", "groups_sha256"))


QUERIES = {"op11_token_alignment": op11_token_alignment}
ORACLE_SQL: dict[str, str] = {}
