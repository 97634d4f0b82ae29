"""Queries that replay a given table through a stream, in micro-batches, and read what it has written."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from groundwork.operators import dedup
from groundwork.operators.lineage import shared_folder, stored
from groundwork.plans import derive, text
from groundwork.plans.derive import table
from groundwork.plans.store import new_store
from groundwork.streaming import incremental

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def replay(rows: DataFrame, part: Column, parts: int) -> tuple[DataFrame, str]:
    """(a stream of rows, a folder for what comes of it): the parts 0, 1, ... lie there, each in as many files as tasks wrote it, and
    reach the stream one after another through delivered()."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    fs, at = _files(spark, folder)
    fs.deleteOnExit(at(""))
    for name in ("parts", "in", "out"):
        fs.mkdirs(at(name))
    rows.withColumn("__part", part).filter(F.col("__part").between(0, parts - 1)).write.mode("append").partitionBy("__part").parquet(f"{folder}/parts")
    return spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/in"), folder


def _files(spark: SparkSession, folder: str):
    """(the file system of a folder, a function from names to paths in it)."""
    at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    return at("").getFileSystem(spark._jsc.hadoopConfiguration()), at


def delivered(writer: DataStreamWriter, folder: str, spark: SparkSession) -> None:
    """Hands the parts of replay() to the stream that writer writes: each part, with all of its files, is one micro-batch."""
    fs, at = _files(spark, folder)
    left = [s.getPath().getName() for s in fs.listStatus(at("parts"))]
    for name in sorted((n for n in left if n.startswith("__part=")), key=lambda n: int(n.split("=")[1])):
        if not fs.rename(at(f"parts/{name}"), at(f"in/{name.split('=')[1]}")):
            raise OSError(f"{folder}: {name} can't be delivered")
        writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def written(stream: DataFrame, folder: str) -> DataFrame:
    """All that a stream gives for what is there, as a table."""
    spark = stream.sparkSession
    delivered(stream.writeStream.format("parquet").option("path", f"{folder}/out").outputMode("append"), folder, spark)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def x3_stuck_work(spark: SparkSession, d: str) -> DataFrame:
    """Events as steps of their users' work: a view starts it, all else ends it. Work that stands for longer than six hours is told.
    Every 50th event but for the last hours' comes after the rest, too late to count."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    e = table(spark, d, "events")
    status = F.when(F.col("event_type") == "view", "processing").otherwise("done")
    rows = e.select(F.col("user_id").cast("string").alias("key"), status.alias("status"), F.col("ts").cast("timestamp").alias("ts"), ((F.col("event_id") % 50 == 0) & (F.col("ts") < "2024-01-30 10:00:00")).alias("late"))
    day = F.least(F.floor(F.datediff("ts", F.lit("2024-01-01")) / 8), F.lit(2)).cast("int")
    # Spark drops what is older than the watermark that the batch before had, so the last hours are a batch of their own.
    stream, folder = replay(rows, F.when(F.col("late"), 4).when(F.col("ts") >= "2024-01-30 12:00:00", 3).otherwise(day), 5)
    return written(incremental.stuck_work(stream.drop("late"), seconds=21_600, late="1 hour"), folder)


def x1_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Documents arrive in three micro-batches, and the last part of them twice; what is stored then, and whether it has chunks."""
    rows = derive.raw(spark, d)
    again = rows.filter("seq % 10 = 3")
    stream, folder = replay(rows.unionByName(again.withColumn("seq", F.col("seq") + 10**12)), F.when(F.col("seq") >= 10**12, 3).otherwise((F.col("seq") % 30) / 10).cast("int"), 4)
    store = new_store(spark)
    chunks_at = f"{folder}/chunks"
    keep = lambda chunks, batch: chunks.write.mode("overwrite").parquet(f"{chunks_at}/batch={batch}")
    delivered(incremental.ingest(stream, store, F.lit("2024-01-01 00:00:00").cast("timestamp"), keep), folder, spark)
    chunked = spark.read.parquet(chunks_at).groupBy("content_id").agg(F.count("*").alias("n"))
    c = store.read("contents")
    return c.join(chunked, c["id"] == chunked["content_id"], "left").select("source", "source_id", "status", F.length("raw_text").alias("n_chars"), F.col("n").isNotNull().alias("has_chunks"))


def x2_first_seen_by_both(spark: SparkSession, d: str) -> DataFrame:
    """Documents by (language, id) and by (language, fingerprint), delivered twice in four micro-batches: those that are first by both."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    f = dedup.fingerprinted(derive.raw(spark, d))
    keys = stored(f.select("seq", (F.expr(derive.EPOCH) + F.make_dt_interval(secs=F.col("seq"))).alias("ts"), F.concat_ws("\x1f", "source", "source_id").alias("k1"), F.when(F.col("discriminating"), F.concat_ws("\x1f", "source", "content_hash")).alias("k2")))
    most = keys.agg(F.max("seq")).first()[0] or 0
    again = keys.withColumn("seq", F.col("seq") + 10**12)
    half = F.col("seq") % 10**12 * 2 > most
    stream, folder = replay(keys.unionByName(again), half.cast("int") * 2 + (F.col("seq") >= 10**12).cast("int"), 4)
    return written(incremental.first_seen_by_both(stream, late="365 days"), folder).select(F.col("seq").alias("doc_id"), "ts")


QUERIES = {f.__name__: f for f in (x3_stuck_work, x1_ingest, x2_first_seen_by_both)}

_NORM = text._NORM_TEXT

ORACLE_SQL = {
    "x3_stuck_work": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) // 1000 AS t, event_type = 'view' AS p FROM events WHERE event_id % 50 <> 0 OR ts >= TIMESTAMP '2024-01-30 10:00:00'),
l AS (SELECT key, list({'t': t, 'p': p, 'since': CAST(NULL AS BIGINT), 'told': CAST([] AS BIGINT[])} ORDER BY t, p) AS es FROM e GROUP BY key),
r AS (SELECT key, list_reduce(list_prepend({'t': CAST(0 AS BIGINT), 'p': false, 'since': CAST(NULL AS BIGINT), 'told': CAST([] AS BIGINT[])}, es), lambda a, x: {'t': x.t, 'p': x.p,
  'since': CASE WHEN NOT x.p THEN NULL WHEN a.since IS NOT NULL AND x.t <= a.since + 21600000 THEN a.since ELSE x.t END,
  'told': CASE WHEN a.since IS NOT NULL AND x.t > a.since + 21600000 THEN list_append(a.told, a.since) ELSE a.told END}) AS s FROM l),
u AS (SELECT key, unnest(CASE WHEN s.since IS NOT NULL AND s.since + 21600000 <= (SELECT max(t) FROM e) - 3600000 THEN list_append(s.told, s.since) ELSE s.told END) AS ms FROM r)
SELECT key, make_timestamp(ms * 1000) AS since, make_timestamp((ms + 21600000) * 1000) AS reset_at FROM u""",
    "x1_ingest": f"""WITH n AS (SELECT doc_id, lang, text, {_NORM} AS t, row_number() OVER (PARTITION BY lang, {_NORM} ORDER BY doc_id % 30 // 10, doc_id) AS k FROM documents)
SELECT lang AS source, CAST(doc_id AS VARCHAR) AS source_id, 'pending' AS status, length(text) AS n_chars, t <> '' AS has_chunks FROM n WHERE k = 1 OR t = ''""",
    "x2_first_seen_by_both": f"WITH n AS (SELECT doc_id, {_NORM} AS t, row_number() OVER (PARTITION BY lang, {_NORM} ORDER BY doc_id) AS k FROM documents) SELECT doc_id, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS ts FROM n WHERE k = 1 OR t = ''",
}
