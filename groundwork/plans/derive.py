"""The library's tables, derived from the given ones: in Spark, and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP '2024-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw content: the language is the source, so that copies meet within one."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("seq"), F.col("lang").alias("source"), F.col("doc_id").cast("string").alias("source_id"), F.lit("").alias("source_url"), F.lit(None).cast("string").alias("title"), F.lit("text").alias("media_type"), F.col("text").alias("raw_text"))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a status from their labels; a content with conversations points to the last one."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    last = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.max("turn").alias("turn"))
    status = F.when(F.col("quality") == 1, "completed").when(F.col("quality") == 0, "failed").when(F.col("doc_id") % 2 == 0, "pending").otherwise("processing")
    out = d.join(l.select("doc_id", "quality"), "doc_id", "left").join(last, "doc_id", "left")
    return out.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("lang").alias("source"),
        F.col("doc_id").cast("string").alias("source_id"),
        F.col("text").alias("raw_text"),
        status.alias("status"),
        (F.expr(EPOCH) + F.make_dt_interval(secs=F.col("doc_id"))).alias("created_at"),
        F.when(F.col("turn").isNotNull(), F.concat_ws(":", "doc_id", "turn")).alias("current_analysis_id"),
        F.col("doc_id"),
    )


CONTENTS_SQL = """contents AS (SELECT CAST(d.doc_id AS VARCHAR) AS id, lang AS source, CAST(d.doc_id AS VARCHAR) AS source_id, d.text AS raw_text,
  CASE WHEN quality = 1 THEN 'completed' WHEN quality = 0 THEN 'failed' WHEN d.doc_id % 2 = 0 THEN 'pending' ELSE 'processing' END AS status,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(d.doc_id) AS created_at, CASE WHEN turn IS NOT NULL THEN d.doc_id || ':' || turn END AS current_analysis_id, d.doc_id
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY 1) c ON c.conv_id = d.doc_id)"""


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as the history of analyses: one for each turn."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("content_id"), F.col("text").alias("summary"), (F.expr(EPOCH) + F.make_dt_interval(secs=F.col("turn"))).alias("created_at"), "turn")


ANALYSES_SQL = "analyses AS (SELECT conv_id || ':' || turn AS id, CAST(conv_id AS VARCHAR) AS content_id, text AS summary, turn FROM conversations)"


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank lines of documents as claims, with evidence from the labels."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).filter(F.trim("text") != "")
    l = table(spark, sf_dir, "labels").select("doc_id", "quality")
    kind = "array<struct<type:string,description:string>>"
    evidence = F.when(F.col("quality") == 1, F.array(F.struct(F.lit("source").alias("type"), F.lit("seen").alias("description")))).when(F.col("quality") == 0, F.array(F.struct(F.lit("none").alias("type"), F.lit("").alias("description")))).otherwise(F.array().cast(kind))
    return d.join(l, "doc_id", "left").select(F.col("doc_id").alias("content_id"), F.col("line").alias("ord"), "text", F.lit("fact").alias("type"), evidence.cast(kind).alias("evidence"), ((F.col("line") * 37 % 101) / 100.0).alias("confidence"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source of a document's claims: itself for even ids, else the document before it, so that the rules fire."""
    d = table(spark, sf_dir, "documents")
    own = d.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("content_id"), "text")
    other = d.filter("doc_id % 2 = 0").select((F.col("doc_id") + 1).alias("content_id"), "text").join(d.select(F.col("doc_id").alias("content_id")), "content_id", "left_semi")
    return own.unionByName(other)


SOURCES_SQL = "sources AS (SELECT d.doc_id AS content_id, s.text FROM documents d JOIN documents s ON s.doc_id = d.doc_id - d.doc_id % 2)"
CLAIMS_SQL = r"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
claims AS (SELECT l.doc_id AS content_id, line AS ord, l.text, q.quality, (line * 37 % 101) / 100.0 AS confidence FROM lines l LEFT JOIN labels q ON q.doc_id = l.doc_id WHERE trim(l.text) <> '')"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("canonical_name"), F.lit("place").alias("entity_type"), F.lit(None).cast("string").alias("description"))


def alias_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower-cased names, then the name of the region, which all nations of a region ask for."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    low = n.select(F.col("n_nationkey").cast("long").alias("seq"), F.col("n_nationkey").cast("string").alias("entity_id"), F.lower("n_name").alias("alias"))
    region = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select((F.col("n_nationkey") + 1000).cast("long").alias("seq"), F.col("n_nationkey").cast("string").alias("entity_id"), F.col("r_name").alias("alias"))
    return low.unionByName(region)


def third_party_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entity has its lower-cased name; for every fourth, a third party also holds its canonical name."""
    n = table(spark, sf_dir, "nation")
    low = n.select(F.concat(F.lit("l"), "n_nationkey").alias("id"), F.col("n_nationkey").cast("string").alias("entity_id"), F.lower("n_name").alias("alias"))
    held = n.filter("n_nationkey % 4 = 0").select(F.concat(F.lit("t"), "n_nationkey").alias("id"), (F.col("n_nationkey") + 2).cast("string").alias("entity_id"), F.col("n_name").alias("alias"))
    return low.unionByName(held)


ALIASES_SQL = """entities AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS canonical_name FROM nation),
aliases AS (SELECT CAST(n_nationkey AS VARCHAR) AS entity_id, lower(n_name) AS alias FROM nation UNION ALL SELECT CAST(n_nationkey + 2 AS VARCHAR), n_name FROM nation WHERE n_nationkey % 4 = 0)"""


def entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("content_id"), F.col("c_nationkey").cast("string").alias("entity_id"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("c"), "s_suppkey").alias("content_id"), F.col("s_nationkey").cast("string").alias("entity_id"))
    return c.unionByName(s).distinct().withColumn("confidence", F.lit(None).cast("double"))


LINKS_SQL = "links AS (SELECT DISTINCT * FROM (SELECT 'c' || c_custkey AS content_id, CAST(c_nationkey AS VARCHAR) AS entity_id FROM customer UNION ALL SELECT 'c' || s_suppkey, CAST(s_nationkey AS VARCHAR) FROM supplier))"


def merge_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0")
    return n.select(F.col("n_nationkey").cast("long").alias("seq"), F.col("n_nationkey").cast("string").alias("source_id"), (F.col("n_nationkey") + 1).cast("string").alias("target_id"), F.lit(True).alias("delete_source"), F.lit(False).alias("dry_run"))
