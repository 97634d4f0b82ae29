"""Token counts by rank-synchronous merging of ragged arrays.

A block's distinct words lie end to end in one array of symbols. Every round finds each word's lowest-rank pair and
applies it at all its places in that word, for all words at once; words without a pair left drop out. A word's count is
the number of its symbols that survive. No shuffle: a word's count depends on the word alone. A very long word has
thousands of rounds, most of them with few places; it goes through the same rounds by itself, and finds a round's places in
an index from ranks to places instead of by looking through its array.

Null and empty texts have no tokens. Texts are taken whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from groundwork.llm.bpe import Numbered
from groundwork.llm.common import BLOCK_BYTES, pick, text_blocks, tidy

#: Distinct units that a task remembers between blocks; it starts anew beyond that, which changes no result.
REMEMBERED = 300_000
#: Words of more bytes find their places in an index.
LONG = 4096
NONE = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 ones as they are, others from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def every_other(chained: np.ndarray) -> np.ndarray:
    """Of pairs that overlap the one before (chained, from the second on), which apply: every other one of a run, from its left."""
    starts = np.flatnonzero(np.concatenate(([True], ~chained)))
    n = len(chained) + 1
    return (np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))) % 2 == 0


class WordBpe:
    """A vocabulary file of kind "BPE with word ends": merges by rank, a suffix on each word's last symbol."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.pattern = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + end] for s in symbols], np.int64)
        self.size = max(vocab.values()) + 1
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(key)
        self.keys, self.values = key[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def count(self, words: list[bytes]) -> np.ndarray:
        """How many symbols of each word survive; an empty word has none."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        counts = self.count_short([b"" if len(w) > LONG else w for w in words])
        counts[long] = [self.count_long(words[i]) for i in long]
        return counts

    def count_long(self, word: bytes) -> int:
        flat = np.frombuffer(word, np.uint8)
        n = left = len(flat)
        ids = self.inner[flat]
        ids[-1] = self.last[flat[-1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n)  # the symbols that stand next to each one; n is none
        rank = np.full(n, NONE, np.int32)
        places: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(at: np.ndarray) -> None:
            at = at[after[at] < n]
            found = self.rank_of(ids[at], ids[after[at]])
            at, found = at[found != NONE], found[found != NONE]
            rank[at] = found
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            for r, some in zip(found[np.concatenate(([0], cuts))[: len(found)]].tolist(), np.split(at, cuts)):
                if r not in places:
                    places[r] = []
                    heapq.heappush(queue, r)
                places[r].append(some)

        enter(np.arange(n))
        while queue:
            lowest = heapq.heappop(queue)
            hit = np.unique(np.concatenate(places.pop(lowest)))
            hit = hit[rank[hit] == lowest]  # places that have changed since they were entered are of another rank now
            if not len(hit):
                continue
            chained = after[hit[:-1]] == hit[1:]
            if chained.any():
                hit = hit[every_other(chained)]
            gone = after[hit]
            ids[hit] = self.made[lowest]
            rank[gone] = NONE
            after[hit] = after[gone]
            before[after[hit]] = hit
            left -= len(hit)
            touched = np.unique(np.concatenate((hit, before[hit])))
            touched = touched[touched >= 0]
            rank[touched] = NONE
            enter(touched)
        return left

    def count_short(self, words: list[bytes]) -> np.ndarray:
        sizes = np.array([len(w) for w in words], np.int64)
        counts = sizes.copy()
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        ids = self.inner[flat]
        ids[ends[sizes > 0] - 1] = self.last[flat[ends[sizes > 0] - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        rank = np.full(len(ids), NONE, np.int32)  # of the pair of a symbol and the next one
        pair = np.flatnonzero(word[:-1] == word[1:])
        rank[pair] = self.rank_of(ids[pair], ids[pair + 1])
        while len(ids):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            lowest = np.minimum.reduceat(rank, first)
            open_ = lowest != NONE
            size = np.diff(np.append(first, len(ids)))
            if not open_.all():  # words that are done leave
                keep = np.repeat(open_, size)
                counts[word[first[~open_]]] = size[~open_]
                ids, word, rank, lowest, size = ids[keep], word[keep], rank[keep], lowest[open_], size[open_]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, size))
            chained = np.diff(hit) == 1
            if chained.any():
                hit = hit[every_other(chained)]
            ids[hit] = self.made[rank[hit]]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            where = np.cumsum(keep) - 1
            ids, word, rank = ids[keep], word[keep], rank[keep]
            at = where[hit]
            mark = np.zeros(len(ids) + 1, bool)  # the last place takes what stands before the first symbol
            mark[at] = mark[at - 1] = True
            touched = np.flatnonzero(mark[:-1])
            rank[touched] = NONE
            pair = touched[touched + 1 < len(ids)]
            pair = pair[word[pair] == word[pair + 1]]
            rank[pair] = self.rank_of(ids[pair], ids[pair + 1])
        return counts


def lower_chars(text: str) -> str:
    """Each character by itself: a sigma at a word's end is no other letter."""
    return text.lower() if "Σ" not in text else "σ".join(x.lower() for x in text.split("Σ"))


class BlockCounter:
    """Counts blocks of texts; remembers the counts of units (what stands between spaces) and words that it has met."""

    def __init__(self, bpe: WordBpe, remembered: int = REMEMBERED):
        self.bpe, self.remembered = bpe, remembered
        self.find = regex.compile(bpe.pattern).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(bpe.special, key=len, reverse=True)))) if bpe.special else None
        self.forget()

    def forget(self) -> None:
        self.units, self.words = Numbered(), Numbered()
        self.unit_counts, self.word_counts = np.array([], np.int64), np.array([], np.int64)

    def learn(self, units: list[str]) -> None:
        known, places, sizes, extra = len(self.words), [], [], []
        for unit in units:
            parts = self.special.split(unit) if self.special else [unit]
            extra.append(len(parts) - 1)  # each special string is one token
            words = [w for p in parts for w in self.find(lower_chars(p if p.isascii() else unicodedata.normalize("NFC", p)))]
            sizes.append(len(words))
            places += map(self.words.__getitem__, words)
        if len(self.words) > known:
            self.word_counts = np.concatenate((self.word_counts, self.bpe.count([w.encode() for w in list(self.words)[known:]])))
        sums = np.concatenate(([0], np.cumsum(self.word_counts[np.array(places, np.int64)])))
        self.unit_counts = np.concatenate((self.unit_counts, np.diff(sums[np.cumsum([0, *sizes])]) + np.array(extra, np.int64)))

    def count(self, texts: list[str]) -> list[int]:
        if len(self.units) > self.remembered:
            self.forget()
        known, places = len(self.units), []
        for text in texts:
            units = text.split(" ")
            places.append(np.fromiter(map(self.units.__getitem__, units), np.int32, len(units)))
        if len(self.units) > known:
            self.learn(list(self.units)[known:])
        return [int(self.unit_counts[at].sum()) for at in places]


_vocabularies: dict[str, WordBpe] = {}  # of this Python worker: the last one it has used


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens). vocabulary: the content of a vocabulary file, of fixed size; the driver broadcasts it."""
    rows = pick(docs, id_col, text_col, binary=False)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    key = hashlib.sha256(vocabulary.encode()).hexdigest()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _vocabularies:
            _vocabularies.clear()
            _vocabularies[key] = WordBpe(shared.value)
        counter = BlockCounter(_vocabularies[key])
        for ids, texts in text_blocks(batches, BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counter.count(texts), pa.int64())], names=["id", "n_bytes", "n_tokens"])

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)
