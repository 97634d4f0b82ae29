"""Streams against the sequential rule, cut into micro-batches at random."""

import random

from pyspark.sql import functions as F

from groundwork.operators import dedup
from groundwork.plans import streams
from groundwork.streaming import incremental


def sequential_stuck(rows, seconds, watermark):
    out, since = [], {}
    for key, status, t in sorted(rows, key=lambda r: (r[2], r[1])):
        if since.get(key) is not None and t > since[key] + seconds:
            out.append((key, since.pop(key)))
        if status != "processing":
            since.pop(key, None)
        else:
            since.setdefault(key, t)
    return sorted(out + [(k, s) for k, s in since.items() if s + seconds <= watermark])


def test_stuck_work_in_any_micro_batches(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    rnd = random.Random(5)
    rows = [(rnd.choice("abcdef"), rnd.choice(("processing", "processing", "done")), t) for t in sorted(rnd.sample(range(100_000), 120))]
    parts = sorted(rnd.randrange(3) for _ in rows)
    df = spark.createDataFrame([(*r, p) for r, p in zip(rows, parts)], "key string, status string, t long, p int").withColumn("ts", F.timestamp_seconds("t"))
    stream, folder = streams.replay(df.select("key", "status", "ts", "p"), F.col("p"), 3)
    got = streams.written(incremental.stuck_work(stream.drop("p"), seconds=2000, late="60 seconds"), folder)
    assert sorted((r.key, r.t) for r in got.select("key", F.unix_timestamp("since").alias("t")).collect()) == sequential_stuck(rows, 2000, max(r[2] for r in rows) - 60)


def test_first_by_both_keys_equals_the_batch_rule(spark):
    """Identities share their fingerprints: rows are delivered again, in any micro-batch, and fingerprints repeat across identities."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    rnd = random.Random(6)
    hashes = {f"i{n}": rnd.choice(["h1", "h2", "h3", "h4", None, f"own{n}"]) for n in range(25)}
    rows = []
    for seq in range(90):
        identity = f"i{rnd.randrange(25)}"
        rows.append((seq, "s", identity, hashes[identity] or "", hashes[identity] is not None))
    df = spark.createDataFrame(rows, "seq long, source string, source_id string, content_hash string, discriminating boolean").withColumn("content_hash_version", F.lit(2))
    want = sorted(r.seq for r in dedup.within_batch(df).filter("kept").collect())
    keys = df.select("seq", F.timestamp_seconds(F.col("seq") + 10**6).alias("ts"), F.concat("source", F.lit("/"), "source_id").alias("k1"), F.when(F.col("discriminating"), F.col("content_hash")).alias("k2"))
    cut = sorted(rnd.sample(range(90), 2))
    stream, folder = streams.replay(keys, (F.col("seq") > cut[0]).cast("int") + (F.col("seq") > cut[1]).cast("int"), 3)
    got = streams.written(incremental.first_seen_by_both(stream), folder)
    assert sorted(r.seq for r in got.collect()) == want


def test_keys_are_forgotten(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    rows = [(1, 0, "a", 0), (2, 50, "a", 0), (3, 5000, "a", 1), (4, 9000, "b", 1), (5, 9500, "c", 2), (6, 9600, "a", 3)]  # timers fire after a batch's rows
    df = spark.createDataFrame(rows, "seq long, t long, k1 string, p int").select("seq", F.timestamp_seconds(F.col("t") + 10**6).alias("ts"), "k1", F.lit(None).cast("string").alias("k2"), "p")
    stream, folder = streams.replay(df, F.col("p"), 4)
    got = streams.written(incremental.first_seen_by_both(stream.drop("p"), late="10 seconds", keep=6000), folder)
    assert sorted(r.seq for r in got.collect()) == [1, 4, 5, 6]


def test_parts_of_a_stream_are_written_by_many_tasks(spark):
    """Each part is one micro-batch of several files, so no task reads or writes a whole part; a part without rows is none."""
    rows = spark.range(0, 4000, numPartitions=4)
    stream, folder = streams.replay(rows, F.col("id").cast("int") % 2 * 2, 4)
    seen = []
    tell = lambda batch, n: seen.append((sorted({r.id % 2 for r in batch.collect()}), batch.count(), batch.select(F.input_file_name()).distinct().count()))
    streams.delivered(stream.writeStream.foreachBatch(tell), folder, spark)
    assert seen == [([0], 2000, 4), ([1], 2000, 4)]
