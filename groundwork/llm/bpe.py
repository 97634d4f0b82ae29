"""Byte-level BPE encoding and decoding by merge replay over distinct pre-tokens.

Each task collects the distinct pre-tokens of a block of its texts, looks up those that are a token whole, lays the bytes
of the others out in flat arrays, and keeps an inverted index from a pair's merge rank to the positions where it stands.
Ranks are taken in ascending order; each one is applied at all its positions at once and only the neighbours that it
touched get new index entries. A block of BLOCK_BYTES is a corpus of its own: a pre-token's ids depend on nothing else, so
no shuffle is needed and any task can be run again. Where a merge gives a pair of a lower rank than its own, which a
vocabulary may hold, the order inside a word matters, and the word is merged by itself with a heap.

A null or empty text has no tokens. Repeated rows give repeated results. Nothing depends on row order.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from groundwork.llm.common import pick, text_blocks, tidy

#: Distinct units, and distinct pre-tokens, that a task remembers between blocks, and their characters; it starts anew beyond
#: that, which changes no result. A text that is one unit is as long as it is, so a number of units alone bounds nothing.
REMEMBERED, REMEMBERED_CHARS = 200_000, 8 << 20
BLOCK_BYTES = 2 << 20
NONE = np.iinfo(np.int32).max


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file has one line for each token: its bytes in base64, and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class MergeReplay:
    """Encodes many distinct pre-tokens together. ranks: token bytes to rank, which is the token's id too."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.size = max(ranks.values()) + 1
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int32)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words, and each word's number of ids."""
        counts = np.zeros(len(words), np.int64)
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        open_words = np.flatnonzero(whole < 0)
        counts[whole >= 0] = 1
        parts = [words[i] for i in open_words]
        sizes = np.array([len(w) for w in parts], np.int64)
        ids, alive, odd = self._replay(b"".join(parts), sizes)
        ends = np.cumsum(sizes)
        if len(parts):
            full = sizes > 0
            got = np.zeros(len(parts), np.int64)
            got[full] = np.add.reduceat(alive.astype(np.int64), (ends - sizes)[full])
            counts[open_words] = got
        out = np.empty(counts.sum(), np.int64)
        starts = np.cumsum(counts) - counts
        out[starts[whole >= 0]] = whole[whole >= 0]
        slots = np.ones(len(out), bool)
        slots[starts[whole >= 0]] = False
        out[slots] = ids[alive]
        if len(odd):
            again = {int(open_words[i]): self.one_by_one(parts[i]) for i in odd}
            pieces = np.split(out, np.cumsum(counts)[:-1])
            for i, got in again.items():
                pieces[i], counts[i] = np.array(got, np.int64), len(got)
            out = np.concatenate(pieces)
        return out, counts

    def _replay(self, flat: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(flat)
        ids = self.single[np.frombuffer(flat, np.uint8)]
        alive = np.ones(n, bool)
        word = np.repeat(np.arange(len(sizes)), sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        if n:
            ends = np.cumsum(sizes)[sizes > 0]
            after[ends - 1] = -1
            before[np.concatenate(([0], ends[:-1]))] = -1
        here = np.full(n, NONE, np.int32)
        left = np.flatnonzero(after >= 0)
        here[left] = self.rank_of(ids[left], ids[after[left]])
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(at: np.ndarray) -> None:
            at = at[here[at] != NONE]
            if not len(at):
                return
            at = at[np.argsort(here[at], kind="stable")]
            ranks = here[at]
            first = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1])))
            for rank, places in zip(ranks[first].tolist(), np.split(at, first[1:])):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(queue, rank)
                index[rank].append(places)

        enter(left)
        odd = []
        while queue:
            rank = heapq.heappop(queue)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.sort(np.concatenate(lists))
            at = at[here[at] == rank]
            if len(lists) > 1 and len(at):
                at = at[np.concatenate(([True], at[1:] != at[:-1]))]
            if not len(at):
                continue
            # Of pairs that overlap (a run of one symbol), the leftmost goes first: every other one of a run.
            chained = after[at[:-1]] == at[1:]
            if chained.any():
                starts = np.flatnonzero(np.concatenate(([True], ~chained)))
                offset = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
                at = at[offset % 2 == 0]
            gone = after[at]
            new_after = after[gone]
            ids[at], alive[gone], here[gone] = rank, False, NONE
            after[at] = new_after
            inner = new_after >= 0
            before[new_after[inner]] = at[inner]
            here[at] = NONE
            here[at[inner]] = self.rank_of(ids[at[inner]], ids[new_after[inner]])
            prior = before[at]
            prior = prior[prior >= 0]
            here[prior] = self.rank_of(ids[prior], ids[after[prior]])
            touched = np.sort(np.concatenate((at, prior)))
            touched = touched[np.concatenate(([True], touched[1:] != touched[:-1]))]
            late = touched[here[touched] < rank]
            if len(late):  # a rank below the current one: the order of equal ranks would matter, so such words go alone
                odd.append(word[late])
            enter(touched)
        return ids, alive, np.unique(np.concatenate(odd)) if odd else np.array([], np.int64)

    def one_by_one(self, word: bytes) -> list[int]:
        """The ids of one word: the lowest rank first, the leftmost of equal ones. A heap keeps this in n log n steps."""
        parts = [bytes([b]) for b in word]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        pair = lambda i: self.ranks.get(parts[i] + parts[after[i]]) if after[i] < len(parts) else None
        heap = [(rank, i) for i in range(len(parts)) if (rank := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if not parts[i] or pair(i) != rank:
                continue  # one of the two has changed since
            gone = after[i]
            parts[i], parts[gone], after[i] = parts[i] + parts[gone], b"", after[gone]
            if after[i] < len(parts):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (rank := pair(k)) is not None:
                    heapq.heappush(heap, (rank, k))
        return [self.ranks[p] for p in parts if p]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Numbered(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


class Ragged:
    """Rows of numbers end to end; gather() lays chosen rows end to end."""

    def __init__(self, kind: type = np.int32) -> None:
        self.flat, self.start, self.count = np.array([], kind), np.array([], np.int64), np.array([], np.int32)

    def add(self, flat: np.ndarray, counts: np.ndarray) -> None:
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(counts) - counts))
        self.flat, self.count = np.concatenate((self.flat, flat.astype(self.flat.dtype))), np.concatenate((self.count, counts.astype(np.int32)))

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.count[at]
        ends = np.cumsum(counts, dtype=np.int64)
        return self.flat[np.repeat(self.start[at] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)], ends


class BlockEncoder:
    """Encodes blocks of texts; remembers the ids of units and pre-tokens that it has met.

    A unit is a space and what stands up to the next space. No match of the pattern goes across the place before a space
    that a non-space follows, so equal units have equal ids; texts with other spaces are matched as one unit.
    """

    def __init__(self, replay: MergeReplay, pattern: str, remembered: int = REMEMBERED):
        self.replay, self.find, self.remembered = replay, regex.compile(pattern).findall, remembered
        self.loose = regex.compile(r" (?=\s|$)").search
        self.forget_units()
        self.forget_words()

    def forget_units(self) -> None:
        self.units, self.unit_ids, self.unit_chars = Numbered(), Ragged(), 0

    def forget_words(self) -> None:
        self.words, self.word_ids, self.word_chars = Numbered(), Ragged(), 0

    def learn(self, units: list) -> None:
        known, places, sizes = len(self.words), [], []
        for unit in units:
            text = unit[0] if type(unit) is tuple else " " + unit
            self.unit_chars += len(text)
            words = self.find(text)
            sizes.append(len(words))
            places += map(self.words.__getitem__, words)
        if len(self.words) > known:
            new = list(self.words)[known:]
            self.word_chars += sum(map(len, new))
            self.word_ids.add(*self.replay.encode([w.encode() for w in new]))
        ids, ends = self.word_ids.gather(np.array(places, np.int64))
        bounds = np.concatenate(([0], ends))[np.cumsum([0, *sizes])]
        self.unit_ids.add(ids, np.diff(bounds))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.units) > self.remembered or self.unit_chars > REMEMBERED_CHARS:
            self.forget_units()
        if len(self.words) > self.remembered or self.word_chars > REMEMBERED_CHARS:
            self.forget_words()
        known, places, sizes = len(self.units), [], []
        number = self.units.__getitem__
        for text in texts:
            if self.loose(text):
                at = np.array([number((text,))], np.int32)
            else:
                first, *rest = text.split(" ")
                at = np.fromiter(map(number, rest), np.int32, len(rest))
                at = np.concatenate((np.array([number((first,))], np.int32), at))
            places.append(at)
            sizes.append(len(at))
        if len(self.units) > known:
            self.learn(list(self.units)[known:])
        ids, ends = self.unit_ids.gather(np.concatenate(places) if places else np.array([], np.int32))
        bounds = np.concatenate(([0], ends))[np.cumsum([0, *sizes])]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


_replays: dict[str, MergeReplay] = {}  # of this Python worker: the last vocabulary it has used


def encode_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, token_ids, decoded): ids as little-endian unsigned 32-bit integers, and the bytes they decode to.

    ranks is a vocabulary of fixed size, read on the driver and broadcast. Null texts count as empty: no tokens, no bytes.
    Very long texts are taken whole; a task holds a block of texts, or one text, at a time.
    """
    rows = pick(docs, id_col, text_col, binary=False)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    key = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _replays:
            _replays.clear()
            _replays[key] = MergeReplay(shared.value)
        replay = _replays[key]
        encoder = BlockEncoder(replay, pattern)
        for ids, texts in text_blocks(batches, BLOCK_BYTES):
            found = encoder.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(x) for x in found], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in found], pa.binary()), pa.array([replay.decode(x.tolist()) for x in found], pa.binary())],
                names=["id", "n_tokens", "token_ids", "decoded"],
            )

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    return rows.mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)
