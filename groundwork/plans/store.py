"""Queries that go through stored tables: commits below the shared folder, read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.operators import warehouse
from groundwork.operators.lineage import shared_folder
from groundwork.plans import derive


def new_store(spark: SparkSession) -> warehouse.Warehouse:
    """An empty warehouse, which goes when the session's JVM ends."""
    root = f"{shared_folder(spark)}/warehouse-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return warehouse.Warehouse(spark, root)


def s9_stored_analyses(spark: SparkSession, d: str) -> DataFrame:
    """Contents are stored; two runs add the conversations' turns as analyses and move the pointers, and the second repeats a part."""
    store = new_store(spark)
    nothing = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in warehouse.SCHEMAS["contents"].split(", ")}
    contents = derive.contents(spark, d).withColumn("current_analysis_id", F.lit(None).cast("string"))
    store.write("contents", contents.select(*(c if c in contents.columns else x.alias(c) for c, x in nothing.items())))
    a = derive.analyses(spark, d).join(contents.select(F.col("id").alias("content_id")), "content_id", "left_semi")
    for part in ("turn < 3", "turn >= 2"):
        some = a.filter(part).select("id", "content_id", F.lit("fact").alias("analysis_type"), "summary", F.lit(None).alias("structured_json"), F.lit(None).alias("model"), F.lit("1").alias("prompt_version"), F.lit(1).alias("chunk_count"), "created_at")
        store.save_analyses(some)
    counts = store.read("analyses").groupBy("content_id").agg(F.count("*").alias("n_analyses"))
    c = store.read("contents")
    return c.join(counts, c["id"] == counts["content_id"], "left").select("id", "status", "current_analysis_id", F.coalesce("n_analyses", F.lit(0)).alias("n_analyses"))


QUERIES = {f.__name__: f for f in (s9_stored_analyses,)}

ORACLE_SQL = {
    "s9_stored_analyses": f"WITH {derive.CONTENTS_SQL} SELECT id, status, CASE WHEN max(turn) IS NOT NULL THEN id || ':' || max(turn) END AS current_analysis_id, count(turn) AS n_analyses FROM contents LEFT JOIN conversations ON conv_id = doc_id GROUP BY id, status",
}
