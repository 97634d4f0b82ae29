"""Inventory of binary assets: the type by the first bytes, the gate, and collapsing names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 200 * 1024 * 1024
# First bytes (in hex) of each type, and the extension of each type.
MAGIC = (("image/jpeg", "FFD8FF"), ("image/png", "89504E470D0A1A0A"), ("image/gif", "47494638"), ("audio/mpeg", "494433"))
EXTENSIONS = {"image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "audio/mpeg": ".mp3", "audio/wav": ".wav", "image/webp": ".webp", "video/mp4": ".mp4", "audio/mp4": ".m4a"}


def sniffed(content: Column) -> Column:
    """The type by the first 64 bytes; null if they say nothing. The name's extension is never asked."""
    head = F.hex(F.substring(content, 1, 64))
    fourcc = F.substring(head, 17, 8)
    box = F.regexp_extract(head, "^((?:[0-9A-F]{2}){0,32}?)66747970((?:[0-9A-F]{2}){0,8})", 0)
    brand = F.regexp_extract(head, "^(?:[0-9A-F]{2}){0,32}?66747970((?:[0-9A-F]{2}){0,8})", 1)
    kind = F.when(head.startswith("52494646"), F.when(fourcc == F.lit("57415645"), "audio/wav").when(fourcc == F.lit("57454250"), "image/webp")).when(box != "", F.when(brand.startswith("4D3441"), "audio/mp4").otherwise("video/mp4"))
    for name, magic in MAGIC:
        kind = F.when(~head.startswith("52494646") & (box == "") & head.startswith(magic), name).otherwise(kind)
    return kind


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of all files below path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def inventory(assets: DataFrame) -> DataFrame:
    """(path, length, content_type, family, error_type) of assets (path, length, content)."""
    kind = sniffed(F.col("content"))
    return assets.select("path", "length", kind.alias("content_type"), F.substring_index(kind, "/", 1).alias("family"), F.when(kind.isNull(), "MEDIA_TYPE_UNSUPPORTED").alias("error_type"))


def gate(rows: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """rows (url, length, sniffed_type, declared_type, media_type) with content_type, error_type and file name.

    Too large, then a type that isn't media or not of the declared family. The name comes from the URL, so repeats meet.
    """
    kind = F.coalesce("sniffed_type", F.lower(F.trim(F.substring_index("declared_type", ";", 1))))
    error = F.when(F.col("length") > most, "MEDIA_TOO_LARGE").when(~F.col("media_type").isin("video", "audio", "image") | kind.isNull() | ~F.startswith(kind, F.concat(F.col("media_type"), F.lit("/"))), "MEDIA_TYPE_UNSUPPORTED")
    ext = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    name = F.concat(F.substring(F.sha2(F.col("url").cast("binary"), 256), 1, 16), F.coalesce(ext[kind], F.lit(".bin")))
    return rows.withColumns({"content_type": kind, "error_type": error, "file_name": F.when(error.isNull(), name)})


def distinct_names(gated: DataFrame) -> DataFrame:
    return gated.filter("error_type is null").dropDuplicates(["file_name"])


def as_raw(inventory_rows: DataFrame) -> DataFrame:
    """Good assets as raw content."""
    none = F.lit(None).cast("string")
    return inventory_rows.filter("error_type is null").select(F.lit("media_file").alias("source"), F.sha2(F.col("path").cast("binary"), 256).substr(1, 16).alias("source_id"), F.lit("").alias("source_url"), F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("title"), none.alias("author"), none.alias("author_id"), none.alias("description"), F.col("family").alias("media_type"), F.col("path").alias("media_path"), none.alias("raw_text"), none.alias("transcript"), none.alias("ocr_text"))
