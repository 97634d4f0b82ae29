"""Near-duplicate groups with SuperMinHash signatures, banding, verification on full sets and union-find grouping.

1. One pass over the texts gives each document its number of distinct word shingles, a 128-bit digest of the set, and the
   keys of its bands. SuperMinHash deals each element's ranks over the slots by a permutation of its own, so slots fill
   evenly, and stops an element as soon as no slot can improve.
2. Documents with equal sets form a class, by an aggregate that combines before it shuffles; its smallest id stands for it.
3. In every band bucket each member is paired with the smallest id (a star), and the distinct pairs are verified on full
   sets. Union-find contracts what is linked.
4. Buckets whose other members are still in several groups are compared whole, in blocks of two parts that are dealt out
   over tasks: exact intersections of all their sets. A part has block / 2 rows or part_shingles shingles on average,
   whichever is less. A block returns a spanning forest of its links, so no group's pairs are ever emitted. Union-find again.

With bands of four slots, the number of bands is chosen so that a pair at the threshold shares no bucket with a
probability of at most `miss`; every pair that shares a bucket is decided exactly.

Hot keys: aggregates are written before they are joined, so that both sides of a join are dealt afresh and a hot partition
can be split; classes with more than a thousandth of all rows are sent to every task; empty sets take part in no join.

A document with fewer words than a shingle has its whole sequence as one; a null text or one without words has an empty
set and links with nothing. A null id links with nothing. Rows that share an id are one document: if their texts differ,
each of them counts, and what is linked with any of them is in one group. Very long texts are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwork.llm.common import checkpointed, parts_of, pick, text_blocks, tidy

SLOTS = 4  # of a band
REMEMBERED = 250_000
#: Rows of a few numbers that a broadcast may hold.
BROADCAST_ROWS = 500_000
_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class _WordHash(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M[0]
    x = (x ^ (x >> np.uint64(29))) * _M[1]
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Distinct hashes of the word shingles of texts, as sorted arrays. Words are what ASCII blanks separate, A-Z lower-cased."""

    def __init__(self, words: int):
        self.words, self.hash = words, _WordHash()

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        out, k = [], self.words
        for text in texts:
            ws = text.lower().split()
            h = np.fromiter(map(self.hash.__getitem__, ws), np.uint64, len(ws))
            if not len(ws):
                out.append(h)
                continue
            size = min(k, len(ws))
            x = np.full(len(ws) - size + 1, size, np.uint64)
            for i in range(size):
                x = _mixed(x * _M[2] + h[i : len(h) - size + 1 + i])
            x.sort()
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        return out


def super_min_hash(elements: np.ndarray, doc: np.ndarray, docs: int, m: int) -> np.ndarray:
    """m slots of 16 bits for each document. elements: hashes, doc: the number of the document that holds each."""
    best = np.full(docs * m, np.inf)
    perm = None
    for j in range(m):
        x = _mixed(elements + np.uint64((j + 1) * int(_M[2]) % 2**64))
        rank = j + (x >> np.uint64(11)).astype(np.float64) * 2.0**-53
        k = j + (_mixed(x) % np.uint64(m - j)).astype(np.int64)
        if perm is None:
            slot = k
        else:
            row = np.arange(len(k))
            slot = perm[row, k].astype(np.int64)
            perm[row, k] = perm[:, j]
        np.minimum.at(best, doc * m + slot, rank)
        # Early stop: elements of documents all of whose slots are below the next ranks have no part any more.
        open_ = best.reshape(docs, m).max(1) >= j + 1
        keep = open_[doc]
        if not keep.any():
            break
        if perm is None:
            perm = np.tile(np.arange(m, dtype=np.min_scalar_type(m)), (int(keep.sum()), 1))
            at = k[keep]
            perm[np.arange(len(at)), at] = 0
        elif not keep.all():
            perm = perm[keep]
        elements, doc = elements[keep], doc[keep]
    return (_mixed(best.view(np.uint64)) >> np.uint64(48)).astype(np.uint16).reshape(docs, m)


def bands_for(similarity: float, miss: float) -> int:
    return max(1, math.ceil(math.log(miss) / math.log(1 - similarity**SLOTS)))


_SIGNED = [("text_hash", T.LongType()), ("n_shingles", T.LongType()), ("digest", T.BinaryType()), ("bands", T.ArrayType(T.LongType()))]


def signatures(docs: DataFrame, words: int = 5, similarity: float = 0.8, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, n_shingles, digest, bands): text_hash is Spark's xxhash64 of the text; no bands for empty sets."""
    rows, bands = pick(docs, id_col, text_col), bands_for(similarity, miss)
    m = bands * SLOTS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        salt = _mixed(np.arange(1, bands + 1, dtype=np.uint64) * _M[2])
        for ids, texts in text_blocks(batches, 2 << 20):
            sets = shingler.sets(texts)
            sizes = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets)
            full = np.flatnonzero(sizes)
            doc = np.repeat(np.arange(len(full)), sizes[full])
            digest = np.zeros((2, len(sets)), np.uint64)
            keys = np.empty((0, bands), np.int64)
            if len(full):
                at = np.cumsum(sizes[full]) - sizes[full]
                digest[0, full], digest[1, full] = np.add.reduceat(_mixed(flat), at), np.add.reduceat(_mixed(flat * _M[2] + _M[0]), at)
                slots = super_min_hash(flat, doc, len(full), m)
                keys = _mixed(np.ascontiguousarray(slots).view(np.uint64) + salt).view(np.int64)
            lists, digests = iter(keys.tolist()), digest.T.tobytes()
            hashes = np.array([xxhash.xxh64_intdigest(t, seed=42) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(hashes), pa.array(sizes), pa.array([digests[i : i + 16] for i in range(0, len(digests), 16)], pa.binary()), pa.array([next(lists) if n else [] for n in sizes.tolist()], pa.list_(pa.int64()))],
                names=["id", "text_hash", "n_shingles", "digest", "bands"],
            )

    return rows.mapInArrow(tidy(run), T.StructType([T.StructField("id", rows.schema["id"].dataType), *(T.StructField(n, t) for n, t in _SIGNED)]))


def verified(pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) of those pairs (a, b, text_a, text_b) whose sets have 100 * intersection >= percent * union."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last, held = Shingler(words), None, None
        for batch in parts_of(batches, "text_a"):
            ta, tb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = []
            for x, y in zip(ta, tb):
                if y != last:  # rows come by the star's centre
                    last, held = y, shingler.sets([y])[0]
                s = shingler.sets([x])[0]
                both = len(np.intersect1d(s, held, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(held) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(tidy(run), T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def _forest(sets: list[np.ndarray], labels: list, percent: int) -> list[tuple]:
    """Links between different labels that join all that is linked in the block."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    shared = values[counts > 1]  # an element of one set adds to no intersection
    inter = np.zeros((len(sets), len(sets)), np.float32)
    places = [np.flatnonzero(np.isin(s, shared, assume_unique=True)) for s in sets]
    cols = [np.searchsorted(shared, s[p]) for s, p in zip(sets, places)]
    for lo in range(0, len(shared), 4096):
        part = np.zeros((len(sets), min(4096, len(shared) - lo)), np.float32)
        for i, c in enumerate(cols):
            c = c[(c >= lo) & (c < lo + 4096)] - lo
            part[i, c] = 1
        inter += part @ part.T
    linked = 100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter)
    parent = {x: x for x in labels}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in np.argwhere(np.triu(linked, 1)).tolist():
        a, b = root(labels[i]), root(labels[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((max(a, b), min(a, b)))
    return out


def block_links(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): links between labels. rows: (task, label, text), the rows of a task following each other."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        task, held = None, []

        def done() -> list[tuple]:
            if len({x[0] for x in held}) < 2:
                return []
            return _forest([x[1] for x in held], [x[0] for x in held], percent)

        for batch in parts_of(batches, "text"):
            links = []
            for key, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if key != task:
                    links += done()
                    task, held = key, []
                held.append((row[0], shingler.sets(row[1:])[0]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], batch.schema.field(1).type), pa.array([x[1] for x in links], batch.schema.field(1).type)], names=["a", "b"])
        links = done()
        if links:
            kind = pa.array([held[0][0]]).type
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], kind), pa.array([x[1] for x in links], kind)], names=["a", "b"])

    kind = rows.schema["label"].dataType
    return rows.select("task", "label", "text").mapInArrow(tidy(run), T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b), for every node but the smallest ones.

    Union-find as joins: large and small stars in turn. Each round is written to the checkpoint folder, and the rounds
    end when the links have become stars. The smallest neighbours are broadcast up to BROADCAST_ROWS rows of two ids, and
    written first beyond that.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    edges = checkpointed(edges)
    facts = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())  # noqa: E731  one row
    seen = facts(edges)
    sent = lambda low: F.broadcast(low) if 2 * seen[0] <= BROADCAST_ROWS else checkpointed(low)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        edges = both.join(sent(low), "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a > b").distinct()
        low = edges.groupBy("a").agg(F.min("b").alias("low"))
        near = edges.join(sent(low), "a")
        edges = near.select("a", F.col("low").alias("b")).unionByName(near.select(F.col("b").alias("a"), F.col("low").alias("b"))).filter("a > b").distinct()
        edges = checkpointed(edges)
        if (now := facts(edges)) == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _few(df: DataFrame) -> DataFrame:
    """A written df, broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, miss: float = 1e-6, block: int = 768, part_shingles: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept): one row for each row of docs; component_id is the smallest id of its group."""
    similarity = percent / 100
    signed = checkpointed(signatures(docs, words, similarity, miss, id_col, text_col))
    some = signed.filter("n_shingles > 0 and id is not null")
    # Classes: equal sets have equal bands, and one text stands for all.
    first = F.min(F.struct("id", "text_hash"))
    classes = checkpointed(some.groupBy("digest").agg(first.alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("rows")).select("digest", "first.id", "first.text_hash", "n", "bands", "rows"))
    member = classes.select(F.explode("bands").alias("bucket"), "digest", "id", "n")
    stars = member.groupBy("bucket").agg(F.min(F.struct("id", "digest")).alias("low"), F.max("id").alias("high")).filter("low.id < high")
    stars = checkpointed(stars.select("bucket", F.col("low.id").alias("low"), F.col("low.digest").alias("low_digest")))
    within = checkpointed(member.join(stars, "bucket"))
    pairs = checkpointed(within.filter("id > low").select(F.col("id").alias("a"), F.col("low").alias("b"), "digest", "low_digest").distinct())
    need = pairs.select("digest").unionByName(pairs.select(F.col("low_digest").alias("digest"))).distinct()
    wanted = _few(checkpointed(classes.join(need, "digest", "left_semi").select("digest", "id", "text_hash")))
    rows = pick(docs, id_col, text_col)
    texts = checkpointed(rows.withColumn("text_hash", F.xxhash64("text")).join(wanted, ["id", "text_hash"]).select("digest", "text").dropDuplicates(["digest"]))
    with_a = pairs.join(texts.withColumnRenamed("text", "text_a"), "digest")
    with_b = with_a.drop("digest").join(texts.select(F.col("digest").alias("low_digest"), F.col("text").alias("text_b")), "low_digest")
    # Ids that occur with several texts link the classes of these.
    several = checkpointed(some.groupBy("id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).filter("x < y").select("id"))
    same = some.select("id", "digest").join(_few(several), "id", "left_semi").distinct().join(classes.select(F.col("id").alias("b"), "digest"), "digest").select(F.col("id").alias("a"), "b")
    found = components(verified(with_b, words, percent).unionByName(same))
    # What the stars have left open: buckets whose other members are in several groups.
    labelled = within.join(found, within["id"] == found["node"], "left").select("bucket", "digest", "id", "n", "low", F.coalesce("component", "id").alias("label"))
    others = checkpointed(labelled.filter("id > low"))
    parts = F.ceil(F.greatest(F.col("size") / (block // 2), F.col("shingles") / part_shingles)).cast("int")
    open_ = others.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("size"), F.sum("n").alias("shingles")).filter("x < y").select("bucket", F.least(parts, F.col("size").cast("int")).alias("parts"))
    open_ = checkpointed(open_)
    dealt = others.join(open_, "bucket").withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
    # A block holds two parts, or the bucket's only one; pairs within a part meet in every block that holds it.
    dealt = dealt.withColumn("other", F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))).filter("parts = 1 or part <> other")
    tasks = dealt.select(F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")).alias("task"), "digest", "label")
    tasks = tasks.join(texts, "digest").select("task", "label", "text")
    second = components(block_links(tasks.repartition("task").sortWithinPartitions("task"), words, percent))
    named = classes.select("digest", "rows", "id").join(found, F.col("id") == found["node"], "left").select("digest", "rows", F.coalesce("component", "id").alias("label"))
    named = checkpointed(named.join(second, named["label"] == second["node"], "left").select("digest", "rows", F.coalesce("component", "label").alias("component")))
    # One row for each row of docs: classes with a thousandth of all rows or more are at most a thousand.
    total = named.agg(F.sum("rows")).first()[0] or 0
    heavy = named.filter(F.col("rows") * 1000 >= total).select("digest", F.col("component").alias("heavy"))
    out = signed.select("id", "n_shingles", "digest").join(F.broadcast(heavy), "digest", "left")
    counts = (F.col("n_shingles") > 0) & F.col("id").isNotNull()
    done = out.filter(F.col("heavy").isNotNull() | ~counts).select("id", "n_shingles", F.when(counts, F.col("heavy")).otherwise(F.col("id")).alias("component"))
    rest = out.filter(F.col("heavy").isNull() & counts).join(named.filter(F.col("rows") * 1000 < total), "digest").select("id", "n_shingles", "component")
    every = done.unionByName(rest)
    return every.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"))
