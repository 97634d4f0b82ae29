"""Raw content: the one input record, its strict reader, and its projections from other tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The media types of raw content.
MEDIA_TYPES = ("video", "image", "article", "audio", "text", "mixed")

RAW = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("source", "source_id", "source_url", "title", "author", "author_id", "description", "media_type", "media_path", "raw_text", "transcript", "ocr_text")]
)
REQUIRED = ("source", "source_id", "source_url", "media_type")


def violations(df: DataFrame) -> Column:
    """Codes of all that is wrong with a record, in a fixed order."""
    return F.array_compact(
        F.array(
            *(F.when(F.col(c).isNull(), F.lit(f"missing:{c}")) for c in REQUIRED),
            F.when(F.trim("source") == "", F.lit("blank:source")),
            F.when(~F.col("media_type").isin(*MEDIA_TYPES), F.lit("enum:media_type")),
            *([F.when(F.size("__unknown") > 0, F.concat(F.lit("unknown:"), F.array_join(F.array_sort("__unknown"), ",")))] if "__unknown" in df.columns else []),
        )
    )


def split_good(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine): quarantine has the reasons joined by ";"."""
    judged = df.withColumn("__why", violations(df))
    extra = [c for c in ("__why", "__unknown") if c in judged.columns]
    good = judged.filter(F.size("__why") == 0).drop(*extra).withColumn("source", F.trim("source"))
    return good, judged.filter(F.size("__why") > 0).withColumn("reason", F.array_join("__why", ";")).drop(*extra)


def read_json_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Strict reader of JSON lines: records with fields that the schema lacks, or that break a rule, go to quarantine."""
    lines = spark.read.text(path)
    parsed = lines.select("value", F.from_json("value", RAW).alias("r"), F.json_object_keys("value").alias("keys"))
    known = F.array(*(F.lit(f.name) for f in RAW.fields))
    rows = parsed.select("value", F.col("keys").isNull().alias("broken"), "r.*", F.array_except(F.coalesce("keys", F.array().cast("array<string>")), known).alias("__unknown"))
    good, bad = split_good(rows.filter(~F.col("broken")).drop("broken"))
    broken = rows.filter("broken").drop("broken", "__unknown").withColumn("reason", F.lit("not an object"))
    return good.drop("value"), bad.unionByName(broken)


def manual(df: DataFrame, raw_text: str = "raw_text") -> DataFrame:
    """Pasted content as raw content, with is_empty: none of its texts, title or description has anything."""
    has = [c for c in df.columns]
    col = lambda c: F.col(c).cast("string") if c in has else F.lit(None).cast("string")
    texts = [col(raw_text), col("transcript"), col("ocr_text"), col("title"), col("description")]
    empty = F.lit(True)
    for t in texts:
        empty = empty & (F.trim(F.coalesce(t, F.lit(""))) == "")
    return df.select(
        F.lit("manual").alias("source"),
        F.lit("").alias("source_id"),
        F.coalesce(col("source_url"), F.lit("")).alias("source_url"),
        col("title").alias("title"),
        col("author").alias("author"),
        col("author_id").alias("author_id"),
        col("description").alias("description"),
        F.coalesce(col("media_type"), F.lit("text")).alias("media_type"),
        col("media_path").alias("media_path"),
        col(raw_text).alias("raw_text"),
        col("transcript").alias("transcript"),
        col("ocr_text").alias("ocr_text"),
        empty.alias("is_empty"),
    )
