"""Benchmark decontamination with DataFrame functions alone.

A window is `size` consecutive words of an item (or a shorter item whole). Equal windows of all items are one, with a key of
two hashes. Any occurrence of a window of n words holds a block of k = (n + 1) // 2 words that starts at a multiple of
n - k + 1 in the document, so one pass hashes only those blocks of a document, for all window sizes at once, and keeps the
places whose hash is that of a block of some window. Every window that holds such a place is then hashed whole, looked up
among the windows (one row a place, however often a block repeats in the items) and compared word by word, so collisions
add nothing. Items are attached to the distinct windows that a document has.

The windows and their blocks are broadcast if they take at most broadcast_bytes, which is measured first, as are what is
known of documents with a candidate or a hit; beyond that the same joins are shuffles.

Rows go by a key of id and text, so rows that share an id but not their text have results of their own, equal rows have
equal results, and a null id is an id like others. Null and empty texts have no words and are never hit. Very long texts
are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from groundwork.operators.lineage import checkpointed

#: ASCII characters that are no letter or digit end a word.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes that a broadcast may take.
BROADCAST_BYTES = 64_000_000


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; other letters keep their case."""
    ascii_only = F.length(text) == F.octet_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), BETWEEN), "")


def row_key(id_: Column, text: Column) -> tuple[Column, Column]:
    """Two hashes that tell rows apart; never null."""
    return F.xxhash64(id_, text), F.xxhash64(F.lit("row"), text, id_)


def _let(value: Column, use) -> Column:
    """use(value), with value computed once: a slice of a long array costs its own words only."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _block(n: int) -> int:
    return (n + 1) // 2


def _blocks(ws: Column, n: int, step: int) -> Column:
    """(n, place, hash) of the blocks at every step-th place, for windows of n words."""
    k = _block(n)
    places = F.when(F.size(ws) >= k, F.sequence(F.lit(0), F.size(ws) - k, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda p: F.struct(F.lit(n).alias("n"), p.alias("place"), F.xxhash64(F.slice(ws, p + 1, k)).alias("hash")))


class _Benchmark:
    """The distinct windows of the items, (w1, w2, n, window), which items have them, (w1, w2, item), and their blocks."""

    def __init__(self, items: DataFrame, size: int, broadcast_bytes: int, item_col: str, text_col: str):
        bench = items.select(F.col(f"`{item_col}`").cast("string").alias("item"), words(F.col(f"`{text_col}`")).alias("ws")).filter(F.size("ws") > 0)
        n = F.least(F.size("ws"), F.lit(size))
        each = bench.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - n + 1), lambda i: F.slice("ws", i, n))).alias("window"))
        each = each.select("item", "window", F.xxhash64("window").alias("w1"), F.xxhash64(F.lit("window"), "window").alias("w2"))
        self.items = checkpointed(each.dropDuplicates(["item", "w1", "w2"]))
        self.windows = self.items.dropDuplicates(["w1", "w2"]).select("w1", "w2", F.size("window").alias("n"), "window")
        # One row: the window sizes (at most `size` numbers), and what the tables take.
        facts = self.items.agg(F.sort_array(F.collect_set(F.size("window"))).alias("sizes"), F.sum(F.octet_length(F.array_join("window", " ")) + F.octet_length(F.coalesce("item", F.lit(""))) + 200).alias("bytes")).first()
        self.sizes, self.small = facts["sizes"], (facts["bytes"] or 0) <= broadcast_bytes
        whole = lambda n: _blocks(F.col("window"), n, 1)
        made = [self.windows.filter(F.col("n") == n).select(F.explode(whole(n)).alias("b")) for n in self.sizes]
        self.blocks = None
        for part in made:
            self.blocks = part if self.blocks is None else self.blocks.unionByName(part)
        if self.blocks is not None:
            self.blocks = self.blocks.select("b.n", "b.hash").distinct()

    def sent(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df


def _few(df: DataFrame, row_bytes: Column, broadcast_bytes: int) -> DataFrame:
    """A checkpointed df, broadcast if its rows take at most broadcast_bytes."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes)).first()[0] or 0) <= broadcast_bytes else df


def window_hits(docs: DataFrame, items: DataFrame, size: int = 10, broadcast_bytes: int = BROADCAST_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(hits, items): hits (k1, k2, start, n, w1, w2), each place of a row (by its key) where a window stands, once; items (w1, w2, item)."""
    bench = _Benchmark(items, size, broadcast_bytes, item_col, item_text_col)
    k1, k2 = row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    raw = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(f"`{text_col}`").alias("raw"))
    if not bench.sizes:
        none = raw.select("k1", "k2", F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("w1"), F.lit(0).cast("long").alias("w2")).filter(F.lit(False))
        return none, bench.items.select("w1", "w2", "item")
    # Places of a row whose block some window has, each as one number: the place, then the window size in the lowest bits.
    bits = size.bit_length()
    blocks = _let(words(F.col("raw")), lambda ws: F.concat(*(_blocks(ws, n, n - _block(n) + 1) for n in bench.sizes)))
    # The outer form of explode: else a filter on the array's size is inferred below it, which makes the array once more.
    met = raw.select("k1", "k2", F.explode_outer(blocks).alias("b")).select("k1", "k2", F.col("b.n").alias("n"), F.col("b.place").alias("place"), F.col("b.hash").alias("hash")).join(bench.sent(bench.blocks), ["n", "hash"], "left_semi")
    code = F.shiftleft(F.col("place").cast("long"), bits).bitwiseOR(F.col("n").cast("long"))
    places = checkpointed(met.groupBy("k1", "k2").agg(F.collect_set(code).alias("codes")))
    places = _few(places, F.size("codes") * 8 + 64, broadcast_bytes)

    def candidates(ws: Column) -> Column:
        """(start, window) of every window that holds one of the places; places lie so that none comes twice."""

        def around(c: Column) -> Column:
            n, place = c.bitwiseAND(F.lit(2**bits - 1)).cast("int"), F.shiftright(c, bits).cast("int")
            first, last = F.greatest(place - (n - F.shiftright(n + 1, 1)), F.lit(0)), F.least(place, F.size(ws) - n)
            starts = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(ws, s + 1, n).alias("window")))

        return F.flatten(F.transform("codes", around))

    near = raw.join(places, ["k1", "k2"]).select("k1", "k2", F.explode_outer(_let(words(F.col("raw")), candidates)).alias("c"))
    near = near.select("k1", "k2", "c.start", F.col("c.window").alias("own"), F.xxhash64("c.window").alias("w1"))
    hits = near.join(bench.sent(bench.windows), "w1").filter("own = window")
    return checkpointed(hits.select("k1", "k2", "start", "n", "w1", "w2").distinct()), bench.items.select("w1", "w2", "item")


def _by_key(hits: DataFrame, items: DataFrame) -> DataFrame:
    """(k1, k2, spans, items): the merged hit stretches as (first, end) words, and the distinct items, of each row that is hit."""
    end = (F.col("start") + F.col("n")).cast("long")
    before = W.partitionBy("k1", "k2").orderBy("start", "n").rowsBetween(W.unboundedPreceding, -1)
    sofar = W.partitionBy("k1", "k2").orderBy("start", "n").rowsBetween(W.unboundedPreceding, 0)
    placed = hits.select("k1", "k2", "start", "n", end.alias("end"), F.max(end).over(before).alias("reached"))
    placed = placed.withColumn("stretch", F.sum((F.col("start") > F.coalesce("reached", F.lit(-1))).cast("int")).over(sofar))
    spans = placed.groupBy("k1", "k2", "stretch").agg(F.min("start").cast("long").alias("first"), F.max("end").alias("end"))
    spans = spans.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("spans"))
    found = hits.select("k1", "k2", "w1", "w2").distinct().join(items, ["w1", "w2"]).groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return spans.join(found, ["k1", "k2"], "left")


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, broadcast_bytes: int = BROADCAST_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_hit, spans, items): one row for each row of docs; spans are the merged hit stretches as (first, end) words, items the distinct items as strings."""
    hits, having = window_hits(docs, items, size, broadcast_bytes, id_col, text_col, item_col, item_text_col)
    by_key = checkpointed(_by_key(hits, having))
    by_key = _few(by_key, F.size("spans") * 32 + F.coalesce(F.octet_length(F.array_join("items", ",")), F.lit(0)) + 100, broadcast_bytes)
    k1, k2 = row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    every = docs.select(F.col(f"`{id_col}`").alias("doc"), F.size(words(F.col(f"`{text_col}`"))).cast("long").alias("n_words"), k1.alias("k1"), k2.alias("k2"))
    spans = F.coalesce("spans", F.array().cast("array<struct<first:bigint,end:bigint>>"))
    return every.join(by_key, ["k1", "k2"], "left").select(
        F.col("doc").alias(id_col),
        "n_words",
        F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"]).alias("n_hit"),
        spans.alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def _same_row(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> Column:
    k1, k2 = row_key(docs[f"`{id_col}`"], docs[f"`{text_col}`"])
    return (k1 == found["k1"]) & (k2 == found["k2"])


def remove_contaminated(docs: DataFrame, items: DataFrame, size: int = 10, broadcast_bytes: int = BROADCAST_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without those that a window hits."""
    hits, _ = window_hits(docs, items, size, broadcast_bytes, id_col, text_col, item_col, item_text_col)
    hit = hits.select("k1", "k2").distinct()
    return docs.join(_few(hit, F.lit(32), broadcast_bytes), _same_row(docs, hit, id_col, text_col), "left_anti")


_SEPARATOR = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # BETWEEN, on texts that still have their capitals


def remove_spans(docs: DataFrame, items: DataFrame, size: int = 10, broadcast_bytes: int = BROADCAST_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, with the hit words cut out of the texts, and what stands between two of them."""
    hits, having = window_hits(docs, items, size, broadcast_bytes, id_col, text_col, item_col, item_text_col)
    by_key = checkpointed(_by_key(hits, having).select("k1", "k2", "spans"))
    text = docs[f"`{text_col}`"]
    late = F.coalesce(text.rlike(f"^[{_SEPARATOR}]").cast("int"), F.lit(0))  # 1 if the first part is no word: words and separators take turns

    def kept(parts: Column, spans: Column) -> Column:
        """What stands before, between and after the stretches; word n is part 2 n + late."""
        before = lambda i: F.when(i == 0, 0).otherwise(2 * (F.get(spans, i - 1)["end"] - 1) + late + 1).cast("int")
        after = lambda i: F.when(i == F.size(spans), F.size(parts)).otherwise(2 * F.get(spans, i)["first"] + late).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(spans)), lambda i: F.array_join(F.slice(parts, before(i) + 1, after(i) - before(i)), "")), "")

    spans = by_key["spans"]
    parts = F.regexp_extract_all(text, F.lit(f"[^{_SEPARATOR}]+|[{_SEPARATOR}]+"), F.lit(0))
    cut = F.when(spans.isNotNull(), _let(parts, lambda p: kept(p, spans))).otherwise(text)
    joined = docs.join(_few(by_key, F.size("spans") * 32 + 100, broadcast_bytes), _same_row(docs, by_key, id_col, text_col), "left")
    return joined.select(*((cut.alias(c) if c == text_col else docs[f"`{c}`"]) for c in docs.columns))
