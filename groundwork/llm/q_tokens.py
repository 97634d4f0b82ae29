"""Queries of the two tokenizer operators. SQL can't express them; the tests hold them against the public libraries."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm.bpe import encode_decode, read_ranks
from groundwork.llm.common import table
from groundwork.llm.token_counts import count_tokens

#: Tokens that a training window holds.
LIMIT = 2048


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    out = encode_decode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary).withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op4_byte_bpe": op4_byte_bpe, "op10_token_counts": op10_token_counts}
ORACLE_SQL: dict[str, str] = {}
