"""A corpus from raw documents to token ids: each stage works on all that the one before it kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm.bpe import encode_decode, read_ranks
from groundwork.llm.common import shared_folder, table
from groundwork.llm.decontam import remove_contaminated
from groundwork.llm.langid import keep_identified, train_on
from groundwork.llm.near_dedup import near_duplicates
from groundwork.llm.secrets import redact_secrets

RANKS = "byte_bpe_multi_50k.tiktoken"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the languages that the corpus' labels teach go: those that a background of evenly likely trigrams
    explains better than any mixture of the languages, null texts, and texts without a letter. Null ids and langs don't matter."""
    return keep_identified(docs, train_on(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id. A null id stays, and so do empty and null texts;
    rows that repeat an id go or stay together."""
    copies = near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("__copy")).distinct()
    return docs.join(copies, docs["doc_id"] == copies["__copy"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go. Null and empty texts stay, and all documents if the benchmark is empty."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets inside texts are masked; n_chars, where there is such a column, follows the text. Every row stays; null texts stay null."""
    clean = redact_secrets(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids, decoded_sha256): ids as little-endian unsigned 32-bit integers. One row for each row; null and
    empty texts have no tokens."""
    out = encode_decode(docs, read_ranks(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe", byte_bpe),
]

#: Language inference, signatures, automata and merges can't be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written as Parquet below the shared folder and read again by the next one."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
