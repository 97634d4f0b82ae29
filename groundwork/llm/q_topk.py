"""Query of the exact top-k search, and the SQL that gives the same rows from all products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm.common import table
from groundwork.llm.vector_file import top_k

K, EVERY, SCALE = 20, 20, 64


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    finite = lambda x: F.abs(x) <= 1.7976931348623157e308
    scaled = F.transform("embedding", lambda x: F.when(finite(x.cast("double")), F.floor(SCALE * x.cast("double")).cast("double")))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", scaled.alias("embedding"))
    found = top_k(vectors.filter(F.col("vec_id") % EVERY == 0), vectors, K)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("score").cast("long").alias("score"))


_OP13 = f"""
WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON len(q.v) = len(c.v) AND (q.vec_id <> c.vec_id OR q.v <> c.v) WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""

QUERIES = {"op13_exact_topk": op13_exact_topk}
ORACLE_SQL = {"op13_exact_topk": _OP13}
