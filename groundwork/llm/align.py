"""Alignment of two tokenizers' tokens over the same bytes.

Each token of a text ends at a byte offset. The ends of the side with fewer tokens drive a search through those of the other
side: from where their unit starts there in doubling steps, then by bisection between the last two. Ends that both sides have
cut the tokens into groups; the ranks of a token's end and of the one before it among the other side's ends give the range of
tokens that it overlaps. A block's units are searched side by side in flat arrays.

A unit is a space and what stands up to the next space that has non-spaces on both sides. Neither tokenizer joins bytes across
such a space: the first one's pattern never matches across it, and no piece of the second one has its space sign after
another character (which is looked up; a vocabulary with such pieces makes the whole text one unit). So equal units have
equal tokens, groups and links, and a task aligns each distinct unit once.

Links of id pairs are counted over all texts by an aggregate. Pairs with at least 1 / HOT of all links, so at most HOT of them,
are sent to every task; what is left of a text's links, none of them frequent, is joined with the counts by a shuffle.

A null or empty text, and one whose tokens don't spell it out (the second vocabulary writes a space for U+2581), has no
tokens: zeros, no groups, no links. Repeated rows give repeated results and count each time. A null id is kept.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from groundwork.llm.bpe import Numbered, Ragged
from groundwork.llm.common import pick, stored, text_blocks, tidy
from groundwork.llm.token_counts import byte_symbols

#: Distinct units that a task remembers between blocks, and their characters; it starts anew beyond that.
REMEMBERED, REMEMBERED_CHARS = 150_000, 8 << 20
BLOCK_BYTES = 2 << 20
#: Pairs of ids that every task gets: at most so many, of 17 bytes each.
HOT = 1 << 17
SHIFT = 32
_SPACE = "▁"
#: The pattern of byte-level vocabularies, a fixed value, and units of so many characters that are encoded by themselves.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG = 4096
_between = re.compile(r"(?<=\S) (?=\S)").split


def gallop(values: np.ndarray, into: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Where each value would stand in an ascending array, at or after its start: doubling steps until a value that isn't less
    is met, then bisection between the last two steps. All values take their steps side by side."""
    low, high, step, n = start.copy(), start.copy(), 1, len(into)
    going = np.flatnonzero(high < n)
    going = going[into[high[going]] < values[going]]
    while len(going):
        low[going] = high[going] + 1
        high[going] = np.minimum(high[going] + step, n)
        step *= 2
        going = going[high[going] < n]
        going = going[into[high[going]] < values[going]]
    going = np.flatnonzero(low < high)
    while len(going):
        middle = (low[going] + high[going]) // 2
        less = into[middle] < values[going]
        low[going[less]] = middle[less] + 1
        high[going[~less]] = middle[~less]
        going = going[low[going] < high[going]]
    return low


def overlaps(short: np.ndarray, long: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hit, first, last) for each token of the side with fewer tokens, from both sides' ends: whether the other side has an end
    where it ends, and its range of the other side's tokens. start: an index of the other side at or before its end."""
    last = gallop(short, long, start)
    hit = long[last] == short
    first = np.concatenate(([0], last[:-1] + hit[:-1])) if len(last) else last
    return hit, first, last


def ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each size, end to end."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)


class Aligner:
    """Aligns blocks of texts. a: a byte-level vocabulary file's content; b: that of a piece model with byte fallback."""

    def __init__(self, a: str, b: bytes):
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        of = {c: i for i, c in enumerate(byte_symbols())}
        spec = json.loads(a)
        tokens = {bytes(of[c] for c in s): i for s, i in spec["model"]["vocab"].items() if all(c in of for c in s) and s not in {t["content"] for t in spec["added_tokens"]}}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.whole = any(_SPACE in p.lstrip(_SPACE) for p in pieces)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_bytes = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            self.a_bytes[i] = token
        self.a_len, self.b_len = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        # What a token writes into the groups' text, at 2 * id before another of its group and side, else at 2 * id + 1.
        self.said = [f"{i}{c}" for i in range(len(self.a_bytes)) for c in ",|"] + [f"{i}{c}" for i in range(len(pieces)) for c in ",;"]
        self.long = Tokenizer.from_str(a)
        self.long.encode_special_tokens = True  # their strings in a text are plain text
        # Ranks say the same as the file's merges if these are listed in the order of the tokens that they make.
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [spec["model"]["vocab"][x + y] for x, y in merges]
        self.ranks = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=tokens, special_tokens={}) if made == sorted(set(made)) else None
        self.forget()

    def forget(self) -> None:
        self.units, self.links, self.groups, self.chars = Numbered(), Ragged(np.int64), [], 0
        self.sizes = np.zeros((0, 5), np.int64)  # tokens of a and b, groups, links, and whether the bytes are not the unit's

    def encode(self, units: list[str]) -> np.ndarray:
        """The first vocabulary's ids of all units, end to end. Units are encoded together, as none changes another's tokens."""
        out, some = [], []
        for unit in units:
            if self.ranks and len(unit) <= LONG:
                some.append(unit)
                continue
            out += [self.ranks.encode_ordinary(" " + " ".join(some))] if some else []
            out.append(self.long.encode(" " + unit, add_special_tokens=False).ids)
            some = []
        out += [self.ranks.encode_ordinary(" " + " ".join(some))] if some else []
        return np.array(list(chain.from_iterable(out)), np.int64)

    def learn(self, units: list[str]) -> None:
        self.chars += sum(map(len, units))
        texts = [b" " + u.encode() for u in units]
        coded = self.b.encode(units, num_threads=1)
        n_b = np.array(list(map(len, coded)), np.int64)
        b = np.fromiter(chain.from_iterable(coded), np.int64, n_b.sum())
        right = np.ones(len(units), bool)
        if b"".join(map(self.b_bytes.__getitem__, b.tolist())) != b"".join(texts):
            right = np.array([b"".join(map(self.b_bytes.__getitem__, ids)) == t for ids, t in zip(coded, texts)])
            b, n_b = b[np.repeat(right, n_b)], n_b[right]
            texts = [t for t, ok in zip(texts, right.tolist()) if ok]
        n_bytes = np.array(list(map(len, texts)), np.int64)
        a = self.encode([u for u, ok in zip(units, right.tolist()) if ok])
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != b"".join(texts):
            raise ValueError("the vocabulary doesn't spell out its own tokens")
        a_ends, b_ends, ends = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b]), np.cumsum(n_bytes)
        upto_a, upto_b = np.searchsorted(a_ends, ends) + 1, np.cumsum(n_b)  # tokens up to the end of each unit
        n_a = np.diff(upto_a, prepend=0)
        a_first = len(a) <= len(b)
        short, long, n_short, upto_long, n_long = (a_ends, b_ends, n_a, upto_b, n_b) if a_first else (b_ends, a_ends, n_b, upto_a, n_a)
        hit, first, last = overlaps(short, long, np.repeat(upto_long - n_long, n_short))
        n = last - first + 1
        mine, other = np.repeat(np.arange(len(short)), n), ranges(first, n)
        pairs = (a[mine] << SHIFT | b[other]) if a_first else (a[other] << SHIFT | b[mine])
        unit = np.repeat(np.arange(len(texts)), n_short)
        n_links = np.bincount(unit, n, len(texts)).astype(np.int64)
        n_groups = np.bincount(unit[hit], minlength=len(texts))
        sizes = np.zeros((len(units), 5), np.int64)
        sizes[:, 4] = ~right
        sizes[right, :4] = np.stack((n_a, n_b, n_groups, n_links), axis=1)
        self.sizes = np.concatenate((self.sizes, sizes))
        self.links.add(pairs, sizes[:, 3])
        # The groups as text: the tokens of both sides by group, side and place.
        cut = np.flatnonzero(hit)
        cut_a, cut_b = (cut, last[cut]) if a_first else (last[cut], cut)
        of_a, of_b = (np.repeat(np.arange(len(cut)), np.diff(c, prepend=-1)) for c in (cut_a, cut_b))
        codes = np.concatenate((2 * a, 2 * (b + len(self.a_bytes))))
        codes[cut_a] += 1
        codes[len(a) + cut_b] += 1
        codes = codes[np.argsort(np.concatenate((2 * of_a, 2 * of_b + 1)), kind="stable")].tolist()
        told, at = iter(np.cumsum(n_a + n_b).tolist()), 0
        for ok in right.tolist():
            end = next(told) if ok else at
            self.groups.append("".join(map(self.said.__getitem__, codes[at:end])))
            at = end

    def align(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
        """(tokens of a, of b, groups, links, the groups told, distinct links, their times) of each text."""
        if len(self.units) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.forget()
        known, places, number = len(self.units), [], self.units.__getitem__
        for text in texts:
            parts = ([] if not text else [text]) if self.whole else _between(text) if text else []
            places.append(np.fromiter(map(number, parts), np.int64, len(parts)))
        if len(self.units) > known:
            self.learn(list(islice(self.units, known, None)))
        for at in places:
            a, b, groups, links, wrong = self.sizes[at].sum(axis=0).tolist()
            if wrong:
                a, b, groups, links, at = 0, 0, 0, 0, at[:0]
            pairs, times = np.unique(self.links.gather(at)[0], return_counts=True)
            yield a, b, groups, links, "".join(map(self.groups.__getitem__, at.tolist()))[:-1], pairs, times


_aligners: dict[str, Aligner] = {}  # of this Python worker: the last one it has used
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def aligned(docs: DataFrame, a: str, b: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, links, times) of a space and the text, one row for each row.

    groups: `a1,a2|b1;a3|b2,b3`, the ids of both sides in order; links: distinct id pairs whose tokens overlap, as
    a << 32 | b; times: how often each of them does. a and b are the contents of vocabulary files, of fixed size; broadcast."""
    rows = pick(docs, id_col, text_col, binary=False)
    shared = docs.sparkSession.sparkContext.broadcast((a, b))
    key = hashlib.sha256(a.encode() + b).hexdigest()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if key not in _aligners:
            _aligners.clear()
            _aligners[key] = Aligner(*shared.value)
        aligner = _aligners[key]
        aligner.forget()
        for ids, texts in text_blocks(batches, BLOCK_BYTES):
            out = list(zip(*aligner.align(texts)))
            bounds = pa.array(np.cumsum([0, *map(len, out[5])]), pa.int32())
            links, times = (pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(x), kind)) for x, kind in ((out[5], pa.int64()), (out[6], pa.int32())))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.string()), links, times], names=["id", *_COUNTS, "groups", "links", "times"])
        aligner.forget()

    fields = [T.StructField("id", rows.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("groups", T.StringType()), T.StructField("links", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType()))]
    return rows.mapInArrow(tidy(run), T.StructType(fields)).withColumnRenamed("id", id_col)


def link_counts(rows: DataFrame) -> DataFrame:
    """(link, n, best) of aligned rows: how many links hold an id pair, and whether no other pair of its b id has more."""
    counts = rows.select(F.explode(F.arrays_zip("links", "times")).alias("x")).groupBy(F.col("x.links").alias("link")).agg(F.sum("x.times").alias("n"))
    counts = stored(counts.withColumn("b", F.col("link").bitwiseAND((1 << SHIFT) - 1)))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row for each id of b's vocabulary at most
    return stored(counts.join(F.broadcast(most), "b").select("link", "n", (F.col("n") == F.col("most")).alias("best")))


def with_link_counts(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """Aligned rows without links and times, with n_best, the links whose count is their b id's highest (ties included), and
    count_sum, the sum of the counts of all links."""
    own = [c for c in rows.columns if c not in ("links", "times")]
    rows = stored(rows.select(F.struct(*own).alias("own"), "links", "times", F.monotonically_increasing_id().alias("row")))
    counts = link_counts(rows)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = counts.filter(F.col("n") * hot >= total).toArrow().sort_by("link")  # at most `hot` rows
    shared = rows.sparkSession.sparkContext.broadcast(tuple(frequent[c].to_numpy() for c in ("link", "n", "best")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link, n, best = shared.value
        for batch in batches:
            flat, times = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy().astype(np.int64)
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            at = np.searchsorted(link, flat)
            at[at == len(link)] = 0
            known = link[at] == flat if len(link) else np.zeros(len(flat), bool)
            sums = [np.concatenate(([0], np.cumsum(x)))[np.concatenate(([0], np.cumsum(sizes)))] for x in ((np.where(known, times * best[at], 0), np.where(known, times * n[at], 0), ~known) if len(link) else (times * 0, times * 0, ~known))]
            bounds = pa.array(sums[2], pa.int32())
            rest = [pa.ListArray.from_arrays(bounds, pa.array(x[~known], pa.int64())) for x in (flat, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.diff(x), pa.int64()) for x in sums[:2]), *rest], names=["row", "n_best", "count_sum", "links", "times"])

    known = stored(rows.select("row", "links", "times").mapInArrow(tidy(run), "row long, n_best long, count_sum long, links array<long>, times array<long>"))
    rest = known.select("row", F.explode(F.arrays_zip("links", "times")).alias("x")).select("row", F.col("x.links").alias("link"), F.col("x.times").alias("times"))
    rest = rest.join(counts.filter(F.col("n") * hot < total), "link").groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    both = rows.select("row", "own").join(known.select("row", "n_best", "count_sum"), "row").join(rest, "row", "left")
    more = lambda of, add: (F.col(of) + F.coalesce(F.col(add), F.lit(0))).alias(of)
    return both.select("own.*", more("n_best", "more_best"), more("count_sum", "more_sum"))
