"""Queries through the extension points: a user's model, and a user's readers of media files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.operators import analyses, capabilities, jobs
from groundwork.plans.derive import table


def _answers():
    """A model that tells a prompt's length, refuses requests with a prompt that starts with a quarter of the letters, and has no answer for short ones."""

    def ask(prompts: list[str]) -> list[str | None]:
        if any(p[:1] in "abcdefg" for p in prompts):
            raise analyses.RequestFailed("LLM_RATE_LIMITED")
        return [f'{{"n": {len(p)}}}' if len(p) >= 100 else None for p in prompts]

    return ask


def k5_infer(spark: SparkSession, d: str) -> DataFrame:
    prompts = table(spark, d, "documents").select("doc_id", F.lower("text").alias("prompt"))
    return analyses.infer(prompts, _answers).select("doc_id", "raw_output", "error_type")


class TitleReader:
    """Reads a page's title as an image's text; can't read a page whose html has a form."""

    name = "titles"

    def is_available(self) -> bool:
        return True

    def text_of(self, content: bytes, path: str) -> str | None:
        if b"<form" in content:
            raise capabilities.CapabilityError
        found = re.search(rb"<title>([^<]*)", content)
        return found and found[1].decode()


def q3_providers(spark: SparkSession, d: str) -> DataFrame:
    """Pages as images, videos and articles: images are read, nothing is there for videos, articles need nothing."""
    p = table(spark, d, "pages")
    kind = F.when(F.col("page_id") % 3 == 0, "image").when(F.col("page_id") % 3 == 1, "video").otherwise("article")
    raw = p.select(F.col("page_id").cast("string").alias("source_id"), F.lit("web").alias("source"), kind.alias("media_type"), F.col("page_id").cast("string").alias("media_path"), F.lit(None).cast("string").alias("transcript"), F.when(F.col("page_id") % 12 == 0, "known").alias("ocr_text"))
    assets = p.select(F.col("page_id").cast("string").alias("path"), F.when(kind == "image", "ocr").when(kind == "video", "transcribe").alias("capability"), F.col("html").cast("binary").alias("content"))
    out, attempts = jobs.enriched(raw, capabilities.extracted_text(assets, {"ocr": TitleReader}))
    return out.join(attempts.drop("source"), "source_id", "left").select("source_id", "ocr_text", "transcript", "capability", "status", "error_type")


QUERIES = {f.__name__: f for f in (k5_infer, q3_providers)}

ORACLE_SQL = {
    "k5_infer": """SELECT doc_id, CASE WHEN NOT r AND length(t) >= 100 THEN '{"n": ' || length(t) || '}' END AS raw_output, CASE WHEN r THEN 'LLM_RATE_LIMITED' WHEN length(t) < 100 THEN 'LLM_REQUEST_FAILED' END AS error_type
FROM (SELECT doc_id, lower(text) AS t, length(text) = 0 OR left(lower(text), 1) BETWEEN 'a' AND 'g' AS r FROM documents)""",
    "q3_providers": """WITH p AS (SELECT CAST(page_id AS VARCHAR) AS source_id, page_id % 3 AS k, page_id % 12 = 0 AS had, contains(html, '<form') AS bad, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages)
SELECT source_id, CASE WHEN had THEN 'known' WHEN k = 0 AND NOT bad AND trim(title) <> '' THEN title END AS ocr_text, CAST(NULL AS VARCHAR) AS transcript, CASE k WHEN 0 THEN 'ocr' WHEN 1 THEN 'transcribe' END AS capability,
CASE WHEN k = 2 THEN NULL WHEN had THEN 'skipped' WHEN k = 1 THEN 'unavailable' WHEN bad THEN 'failed' WHEN trim(title) = '' THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN k = 0 AND NOT had AND bad THEN 'CAPABILITY_FAILED' END AS error_type FROM p""",
}
