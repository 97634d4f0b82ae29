"""Exact top-k inner products with vector-approximation files.

1. Equal vectors are one class, with the k + 1 smallest ids of its rows: a class's other rows can't be among the best k, as
   ties go to smaller ids. (id, vector) pairs are aggregated first, and only the k + 1 first ids of a vector are shuffled.
2. The approximation file: each class's vector is quantised, `bits` a component, into the cells of a grid over its own range. A
   cell bounds each inner product from both sides: |q . v - q . cell| <= min(half a cell * |q|_1, distance to the cell * |q|_2).
3. The scan: blocks of query vectors meet shards of the file, both dealt by hashes of distinct vectors and of a stated size. A
   meeting returns, for each query, the approximations that its own k + 1 best lower bounds don't beat.
4. The file's survivors are ordered by their bounds. The exact vectors of the first k + 1 are read, then of those others whose
   bound still reaches the (k + 1)-th exact score found: the first read makes the result certain, the second completes it.

Only approximations meet all queries; exact vectors are read for the survivors alone. Every query is compared with every
vector that is not its own, which is what exact search over all rows costs: the work grows with queries times rows.

A null id, a null vector, and a vector with null or non-finite components take no part. Vectors are compared with vectors
of their own length only. Equal rows, with one id and one vector, count once; rows of one id with different vectors are
different queries and different results. Only a query's own row is no result of it. A query with fewer candidates gets all
of them. Scores are exact while components are integers and sums of products stay below 2**53; else they are rounded as
sums of doubles are.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundwork.llm.common import checkpointed, tidy

#: Query vectors of a block, approximations of a shard, and scores that a task holds at a time.
BLOCK, SHARD, SCORES = 16_384, 8_192, 1 << 22
#: Share of the sum of absolute products by which a computed double sum may be off.
ROUNDING = 1e-12


def packed(values: np.ndarray) -> list[bytes]:
    """Rows of doubles, each as exact bytes of the smallest of three kinds: int8, int16, double; the first byte tells which.
    Equal rows have equal bytes."""
    values = values + 0.0  # -0.0 becomes 0.0
    whole = (values == np.rint(values)).all(axis=1)
    top = np.abs(values).max(axis=1, initial=0)
    out = []
    for row, w, t in zip(values, whole, top):
        kind = "b" if w and t < 128 else "h" if w and t < 32768 else "d"
        out.append(kind.encode() + row.astype(kind).tobytes())
    return out


def unpacked(rows: Iterable[bytes]) -> np.ndarray:
    return np.array([np.frombuffer(r, chr(r[0]), offset=1) for r in rows], np.float64)


def approximations(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cells, low, step, distance): row i is within step / 2 a component, and distance in all, of low + step * (cells + 0.5)."""
    low, high = values.min(axis=1, initial=np.inf), values.max(axis=1, initial=-np.inf)
    flat = ~(high > low)
    low, high = np.where(flat, np.where(np.isfinite(low), low, 0), low), np.where(flat, 0, high)
    step = np.where(flat, 0, (high - low) / (1 << bits))
    cells = np.clip(np.floor((values - low[:, None]) / np.where(flat, 1, step)[:, None]), 0, (1 << bits) - 1).astype(np.uint8)
    distance = np.sqrt(((values - middles(cells, low, step)) ** 2).sum(axis=1))
    return cells, low, step, distance * (1 + 1e-9)


def middles(cells: np.ndarray, low: np.ndarray, step: np.ndarray) -> np.ndarray:
    return low[:, None] + step[:, None] * (cells + np.where(step > 0, 0.5, 0)[:, None])


def scan(queries: np.ndarray, cells: np.ndarray, low: np.ndarray, step: np.ndarray, distance: np.ndarray, first: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, lower bound, upper bound) of all rows that n others don't certainly come before: by a lower bound above the
    row's upper one, or an equal one and a smaller first id."""
    mid = middles(cells, low, step)
    one, two = np.abs(queries).sum(axis=1), np.sqrt((queries**2).sum(axis=1))
    size = np.abs(mid).max(axis=1, initial=0)
    for a in range(0, len(queries), max(1, SCORES // max(1, len(mid)))):
        q = slice(a, a + max(1, SCORES // max(1, len(mid))))
        near = queries[q] @ mid.T
        slack = np.minimum(one[q, None] * (step / 2)[None, :], two[q, None] * distance[None, :]) + ROUNDING * one[q, None] * size[None, :]
        lower, upper = near - slack, near + slack
        if len(mid) <= n:
            of, row = np.nonzero(np.ones(near.shape, bool))
        else:
            reach = np.partition(lower, len(mid) - n, axis=1)[:, len(mid) - n]
            open_ = upper >= reach[:, None]
            for i in np.flatnonzero(open_.sum(axis=1) > 4 * n):  # many rows at one bound: the smaller ids come first
                best = np.flatnonzero(lower[i] >= reach[i])
                last = best[np.lexsort((first[best], -lower[i][best]))[n - 1]]
                open_[i] &= (upper[i] > reach[i]) | (first <= first[last])
            of, row = np.nonzero(open_)
        yield of + a, row, lower[of, row], upper[of, row]


def _rows(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Distinct (id, v): v as packed bytes; rows that take no part are left out."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).filter("id is not null and v is not null")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) <= 1.7976931348623157e308)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            flat, sizes = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy())
            starts = np.cumsum(sizes) - sizes
            out: list[bytes] = [b""] * len(sizes)
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                for i, v in zip(at, packed(flat[starts[at][:, None] + np.arange(d)])):
                    out[i] = v
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int32()), pa.array(out, pa.binary())], names=["id", "dim", "v"])

    return rows.mapInArrow(tidy(run), "id long, dim int, v binary").groupBy("v", "id", "dim").agg(F.lit(1).alias("n")).drop("n")


def _file(classes: DataFrame, bits: int) -> DataFrame:
    """(c, dim, first, cells, low, step, distance) of classes (c, dim, v, ids)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for d in np.unique(dims):
                some = batch.filter(pa.array(dims == d))
                cells, low, step, distance = approximations(unpacked(some.column(3).to_pylist()).reshape(some.num_rows, d), bits)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), pa.array([x.tobytes() for x in cells], pa.binary()), pa.array(low), pa.array(step), pa.array(distance)], names=["c", "dim", "first", "cells", "low", "step", "distance"])

    return classes.select("c", "dim", F.element_at("ids", 1).alias("first"), "v").mapInArrow(tidy(run), "c long, dim int, first long, cells binary, low double, step double, distance double")


def _meet(n: int):
    def run(queries: pa.Table, file: pa.Table) -> pa.Table:
        names = ["q", "c", "first", "lower", "upper"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not queries.num_rows or not file.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        d = file["dim"][0].as_py()
        column = lambda name: file[name].to_numpy()
        cells = np.frombuffer(b"".join(file["cells"].to_pylist()), np.uint8).reshape(file.num_rows, d)
        q = unpacked(queries["v"].to_pylist()).reshape(queries.num_rows, d)
        found = list(zip(*scan(q, cells, column("low"), column("step"), column("distance"), column("first"), n)))
        of, row, lower, upper = (np.concatenate(x) for x in found)
        return pa.table([queries["q"].to_numpy()[of], column("c")[row], column("first")[row], lower, upper], names=names)

    return run


def _exact(pairs: DataFrame, kinds: DataFrame, classes: DataFrame) -> DataFrame:
    """(q, c, first, same, score, ids) of pairs (q, c, first): reads the exact vectors. same: the two are equal."""
    both = pairs.join(kinds.select("q", F.col("v").alias("qv")), "q").join(classes.select("c", F.col("v").alias("cv"), "ids"), "c")
    number = lambda v: np.frombuffer(v, chr(v[0]), offset=1).astype(np.float64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [float(number(a) @ number(b)) for a, b in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(scores, pa.float64())], names=["q", "c", "first", "same", "ids", "score"])

    both = both.select("q", "c", "first", (F.col("qv") == F.col("cv")).alias("same"), "ids", "qv", "cv")
    return both.mapInArrow(tidy(run), "q long, c long, first long, same boolean, ids array<long>, score double")


def _reaches(bound: str, last: str) -> Column:
    """Whether a row may come before or be the last one, a struct (score, first) that is null if there are fewer rows."""
    return F.col(last).isNull() | (F.col(bound) > F.col(f"{last}.score")) | ((F.col(bound) == F.col(f"{last}.score")) & (F.col("first") <= F.col(f"{last}.first")))


def top_k(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = 8, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, id, score): each query's k rows with the largest inner products, ties to smaller ids, rank from 1.
    Both tables have an integer id and an array of numbers, in the columns named. bits: 1 to 8 of a component's cell."""
    n = k + 1  # one of them may be the query itself
    place = F.row_number().over(W.partitionBy("v", "dim").orderBy("id"))
    classes = _rows(vectors, id_col, vector_col).withColumn("i", place).filter(F.col("i") <= n).groupBy("v", "dim").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = checkpointed(classes.withColumn("c", F.monotonically_increasing_id()).select("c", "dim", "v", "ids"))
    asked = checkpointed(_rows(queries, id_col, vector_col))
    kinds = checkpointed(asked.select("v", "dim").distinct().withColumn("q", F.monotonically_increasing_id()))
    blocks, shards = max(1, math.ceil(kinds.count() / block)), max(1, math.ceil(classes.count() / shard))

    dealt = lambda column, parts: F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = kinds.select("q", "dim", "v", dealt("q", blocks).alias("block"), every(shards).alias("shard")).groupBy("dim", "block", "shard")
    right = _file(classes, bits).select("*", dealt("c", shards).alias("shard"), every(blocks).alias("block")).groupBy("dim", "block", "shard")
    met = left.cogroup(right).applyInArrow(_meet(n), "q long, c long, first long, lower double, upper double")

    last = F.nth_value(F.struct(F.col("lower").alias("score"), "first"), n).over(W.partitionBy("q").orderBy(F.desc("lower"), "first", "c").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    order = F.row_number().over(W.partitionBy("q").orderBy(F.desc("upper"), "first", "c"))
    survivors = checkpointed(met.withColumn("last", last).filter(_reaches("upper", "last")).withColumn("i", order).select("q", "c", "first", "upper", "i"))

    begun = checkpointed(_exact(survivors.filter(F.col("i") <= n), kinds, classes))
    at = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "first", "c"))
    certain = begun.withColumn("i", at).filter(F.col("i") == n).select("q", F.struct("score", "first").alias("last"))
    rest = survivors.filter(F.col("i") > n).join(certain, "q").filter(_reaches("upper", "last"))
    found = begun.unionByName(_exact(rest, kinds, classes)).select("q", "same", "score", F.explode("ids").alias("id"))

    at = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))
    best = found.withColumn("i", at).filter(F.col("i") <= n).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("i", "id", "score", "same"))).alias("best"))
    own = asked.join(kinds, ["v", "dim"]).select(F.col("id").alias("query_id"), "q").join(best, "q")
    others = own.select("query_id", F.slice(F.filter("best", lambda x: ~(x["same"] & (x["id"] == F.col("query_id")))), 1, k).alias("best"))
    return others.select("query_id", F.posexplode("best").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("id"), F.col("x.score").alias("score"))
