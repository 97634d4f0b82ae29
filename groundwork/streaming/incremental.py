"""Streams: incremental ingest, first-seen rows, stuck work, and counts over time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from groundwork.operators import chunks, dedup, warehouse


def first_seen(stream: DataFrame, keys: list[str], time_col: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark; state is dropped as the watermark passes."""
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)


def counts(stream: DataFrame, by: list[str], time_col: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, by, n): rows of each tumbling window."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, window), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def ingest(stream: DataFrame, store: warehouse.Warehouse, as_of=None, chunked: Callable[[DataFrame, int], None] | None = None):
    """A writer: each batch is fingerprinted, freed of duplicates and added to the stored contents.

    chunked(chunks, batch_id) gets the chunks (content_id, chunk_index, chunk_total, chunk) of what the batch has added,
    before it is stored, so that a batch that fails is chunked again; it should replace what it wrote for the same batch id.
    A batch that runs again after it was stored finds its rows there and adds nothing. A batch writes its own rows only.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        if rows.isEmpty():
            return
        stored = store.read("contents")
        fresh = dedup.within_batch(dedup.fingerprinted(rows)).filter("kept")
        judged = dedup.against_stored(fresh, stored).filter("outcome = 'new'")
        have = set(rows.columns)
        field = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c)
        new = judged.select(
            warehouse.stable_id("content", F.col("source"), F.col("source_id")).alias("id"), "source", "source_id",
            *(field(c, "string") for c in ("source_url", "title", "author", "author_id", "description", "media_type", "raw_text", "transcript", "ocr_text")),
            "content_hash", "content_hash_version", "needs_manual_review", F.lit("pending").alias("status"), (as_of if as_of is not None else F.current_timestamp()).alias("created_at"),
            *(F.lit(None).cast(k).alias(c) for c, k in (("current_analysis_id", "string"), ("processed_at", "timestamp"), ("error_type", "string"), ("error_message", "string"))),
        )
        if chunked is not None:
            chunked(chunks.chunk_table(chunks.prepare(new.withColumnRenamed("id", "content_id")), "content_id"), batch_id)
        store.append("contents", new)

    return stream.writeStream.foreachBatch(batch)


class StuckWork(StatefulProcessor):
    """Emits (key, since, reset_at) for a key that stays in processing for longer than `seconds` of event time.

    A row of the key that comes later than that tells it as well as the watermark does, so how rows are cut into micro-batches
    changes nothing. A key that was told starts anew with its next row in processing.
    """

    def __init__(self, seconds: int = 900):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.since = handle.getValueState("since", "since_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """The state is asked for once and told once, whatever number of rows a key has: each question goes to the JVM and back."""
        wait = self.seconds * 1000
        before = since = self.since.get()[0] if self.since.exists() else None
        ended = []
        for ts, status in sorted((t, s) for part in rows for s, t in zip(part["status"], part["ts"].to_numpy("datetime64[ms]").astype("int64").tolist())):
            if since is not None and ts > since + wait:
                ended.append(since)
                since = None
            if status != "processing":
                since = None
            elif since is None:
                since = ts
        if since != before:
            if before is not None:
                self.handle.deleteTimer(before + wait)
            if since is None:
                self.since.clear()
            else:
                self.since.update((since,))
                self.handle.registerTimer(since + wait)
        if ended:
            yield self._told(key, ended)

    def _told(self, key, since: list[int]) -> pd.DataFrame:
        at = pd.to_datetime(pd.Series(since, dtype="int64"), unit="ms")
        return pd.DataFrame({"key": [str(key[0])] * len(since), "since": at, "reset_at": at + pd.Timedelta(milliseconds=self.seconds * 1000)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        since = self.since.get()[0]
        self.since.clear()  # the timer that has fired is gone by itself
        yield self._told(key, [since])

    def close(self) -> None:
        pass


def stuck_work(stream: DataFrame, seconds: int = 900, late: str = "1 minute") -> DataFrame:
    """(key, since, reset_at) from a stream (key, status, ts); the session needs the RocksDB state store."""
    grouped = stream.withWatermark("ts", late).groupBy("key")
    return grouped.transformWithStateInPandas(StuckWork(seconds), outputStructType="key string, since timestamp, reset_at timestamp", outputMode="append", timeMode="eventTime")


#: Bytes of a key's digest in the state.
DIGEST = 16


class FirstOfKeys(StatefulProcessor):
    """Lets the first row of each key through; forgets a key when `keep` seconds of event time have passed since that row.

    Keys (key_digest, digests of DIGEST bytes) come in buckets, and a bucket's keys are one state: it is asked for once and told once in a batch,
    whatever number of keys it has, as each question goes to the JVM and back. A bucket has one timer, for the key that goes next.
    """

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "keys binary, until_ms binary, timer long")

    def _read(self) -> tuple[dict[bytes, int], int | None]:
        """(until when each key is kept, the time of the timer)."""
        if not self.held.exists():
            return {}, None
        keys, until, timer = self.held.get()
        keys = bytes(keys)
        return dict(zip((keys[i : i + DIGEST] for i in range(0, len(keys), DIGEST)), np.frombuffer(bytes(until), "<i8").tolist())), timer

    def _write(self, known: dict[bytes, int], timer: int | None) -> None:
        """timer: the one that stands."""
        next_ = min(known.values(), default=None)
        if timer is not None and timer != next_:
            self.handle.deleteTimer(timer)
        if next_ is None:
            self.held.clear()
            return
        if timer != next_:
            self.handle.registerTimer(next_)
        self.held.update((b"".join(known), np.fromiter(known.values(), "<i8", len(known)).tobytes(), next_))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = None
        for part in rows:
            both = part if best is None else pd.concat([best, part])
            best = both.sort_values(["ts", "seq"], kind="stable").drop_duplicates("key_digest")
        known, timer = self._read()
        new = best[[k not in known for k in best["key_digest"]]]
        if len(new):
            at = new["ts"].to_numpy("datetime64[ms]").astype("int64") + self.keep * 1000
            known.update(zip(map(bytes, new["key_digest"]), at.tolist()))
            self._write(known, timer)
            yield new.drop(columns=["key_digest", "key_bucket"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ended = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        self._write({k: t for k, t in self._read()[0].items() if t > ended}, None)  # the timer that has fired is gone by itself
        yield from ()

    def close(self) -> None:
        pass


def _firsts(rows: DataFrame, key: Column, schema: T.StructType, keep: int, buckets: int) -> DataFrame:
    """The first row of each key of a stream."""
    digest = F.substring(F.unhex(F.sha2(F.coalesce(F.concat(F.lit("k"), key), F.lit("")), 256)), 1, DIGEST)
    dealt = rows.withColumn("key_digest", digest).withColumn("key_bucket", F.pmod(F.xxhash64("key_digest"), F.lit(buckets)))
    return dealt.groupBy("key_bucket").transformWithStateInPandas(FirstOfKeys(keep), outputStructType=schema, outputMode="append", timeMode="eventTime", eventTimeColumnName="ts")


def first_seen_by_both(stream: DataFrame, late: str = "1 hour", keep: int = 30 * 86_400, buckets: int = 2048) -> DataFrame:
    """The rows (seq, ts, k1, k2) of a stream that are the first of their identity k1 and, of these, the first of their fingerprint
    k2; a null k2 counts for nothing. Two keyed states after each other, each with timers that forget a key after `keep` seconds.

    Equal to dedup.within_batch over all rows as long as the rows of an identity share their fingerprint, which rows that are
    delivered again do. Where they don't, an identity counts from its first row on here, even if that row repeats another
    one's fingerprint; within_batch would count it from the first row that it keeps, which no fixed number of keyed states can
    tell. Rows later than the watermark are dropped. The session needs the RocksDB state store.

    Keys are dealt to buckets, each of which is one state of 24 bytes a key: a batch reads and writes the buckets that it has rows for. The
    number of buckets is fixed for the life of a checkpoint.
    """
    kept = T.StructType([f for f in stream.schema.fields if f.name in ("seq", "ts", "k1", "k2")])
    rows = stream.withWatermark("ts", late).select(*(f.name for f in kept.fields))
    once = _firsts(rows, F.col("k1"), kept, keep, buckets)
    return _firsts(once, F.coalesce(F.concat(F.lit("2"), "k2"), F.concat(F.lit("1"), "k1")), kept, keep, buckets)
