"""Language identification as inference in a mixture of languages.

A language is a distribution over byte trigrams of words, hashed into a fixed number of buckets. A document is a mixture:
each word comes from one language, with proportions that expectation-maximisation estimates from the words' likelihoods.
The languages of a document are those that maximise the likelihood less a penalty for each language; the prediction is
the one with the largest proportion, and its score is that proportion.

A document may also be in none of the languages. The empty set of languages competes as a background that gives every
trigram the same log-likelihood, `strictness` of the way from what the languages reach on themselves (the mean
log-likelihood of their own trigrams, the lowest of all languages) down to that of a uniform distribution. A document fits
unless the background explains it better than the mixture by more than `evidence` nats, so short texts are never rejected
on a few odd words. identify() tells that as fits; keep_identified() lets documents that don't fit go.

Training counts come from at most sample_docs documents of each language, those with the smallest hashes; the model is a
table of languages x buckets. Prediction reads whole texts and needs no shuffle. A text that is null or has no letter
is "und" with score 0. Without training rows every text is "und". Repeated rows repeat their results.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwork.llm.bpe import Numbered
from groundwork.llm.common import parts_of, pick, text_blocks, tidy

UNDETERMINED = "und"
BUCKETS = 1 << 15
REMEMBERED = 300_000

#: Every ASCII character but letters ends a word.
_FOLD = bytes(b if 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_FOLD).split()


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text[:200])) or any(map(str.isalpha, text))


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of all words, each between two spaces, and each word's number of them."""
    flat = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8).astype(np.uint32)
    sizes = np.array([len(w) for w in words], np.int64)
    at = np.repeat(np.cumsum(sizes + 2) - sizes - 2, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    code = flat[at] * np.uint32(0x9E3779B1) ^ flat[at + 1] * np.uint32(0x85EBCA6B) ^ flat[at + 2] * np.uint32(0xC2B2AE35)
    code ^= code >> np.uint32(15)
    return ((code * np.uint32(0x27D4EB2F)) >> np.uint32(17)).astype(np.int64), sizes


def training_sample(rows: DataFrame, sample_docs: int) -> DataFrame:
    """(id, text, lang) of about sample_docs documents of each language: the share with the smallest hashes of the id."""
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))  # one row a language
    hashed = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 20))
    return rows.join(F.broadcast(counts), "lang").filter(hashed * F.col("n") < F.lit(sample_docs) * F.lit(float(1 << 20))).select("id", "text", "lang")


def train(rows: DataFrame, sample_docs: int = 2000) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and log-probabilities of buckets (rows) by language. rows: (id, text, lang), lang not null."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist()):
                if words := words_of(text):
                    sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    sums[lang] += np.bincount(trigrams(words)[0], minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    counts = training_sample(rows, sample_docs).mapInArrow(tidy(count), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows a language
    langs = sorted(counts["lang"].unique())
    table = np.full((BUCKETS, len(langs)), 0.5)
    if langs:
        np.add.at(table, (counts["bucket"].to_numpy(), np.searchsorted(langs, counts["lang"])), counts["n"].to_numpy())
        table = np.log(table / table.sum(0))
    return langs, table.astype(np.float32)


class MixtureModel:
    def __init__(self, langs: list[str], table: np.ndarray, penalty: float, rounds: int, strictness: float = 0.6, evidence: float = 60.0):
        self.langs, self.table, self.penalty, self.rounds, self.evidence = langs, table, penalty, rounds, evidence
        reach = float((np.exp(table.astype(np.float64)) * table).sum(0).min()) if langs else 0.0
        self.background = (1 - strictness) * reach - strictness * math.log(BUCKETS)
        self.forget()

    def forget(self) -> None:
        self.words, self.scores = Numbered(), np.empty((0, len(self.langs)), np.float32)

    def _likelihoods(self, words: list[bytes]) -> np.ndarray:
        at, sizes = trigrams(words)
        rows = self.table[at]
        return np.add.reduceat(rows, np.cumsum(sizes) - sizes, axis=0) if len(rows) else np.empty((0, len(self.langs)), np.float32)

    def _mixture(self, share: np.ndarray, peak: np.ndarray, start: np.ndarray, size: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions of each document's allowed languages, and its log-likelihood. share: likelihoods of words, over their largest."""
        doc = np.repeat(np.arange(len(size)), size)
        parts = (allowed / allowed.sum(1, keepdims=True)).astype(np.float32)
        for _ in range(self.rounds):
            weight = share * parts[doc]
            weight /= np.maximum(weight.sum(1, keepdims=True), 1e-30)
            parts = np.add.reduceat(weight, start, axis=0) / size[:, None]
        total = np.maximum((share * parts[doc]).sum(1), 1e-30)
        return parts, np.add.reduceat(np.log(total, dtype=np.float64) + peak, start)

    def predict(self, texts: list[str]) -> list[tuple[str, float, list[tuple[str, float]], bool]]:
        """For each text: language, its proportion, the proportions of the selected languages, and whether the text fits them."""
        out: list = [(UNDETERMINED, 0.0, [], False)] * len(texts)
        if len(self.words) > REMEMBERED:
            self.forget()
        known, kept, places, grams = len(self.words), [], [], []
        for i, text in enumerate(texts):
            words = words_of(text) if text and self.langs and has_letter(text) else ()
            if words:
                kept.append(i)
                places.append(np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)))
                grams.append(sum(map(len, words)))
        if not kept:
            return out
        if len(self.words) > known:
            self.scores = np.concatenate((self.scores, self._likelihoods(list(self.words)[known:])))
        size = np.array([len(p) for p in places])
        start = np.cumsum(size) - size
        scores = self.scores[np.concatenate(places)]
        peak = scores.max(1)
        share = np.exp(scores - peak[:, None])
        single = np.add.reduceat(scores, start, axis=0, dtype=np.float64)
        full, likely = self._mixture(share, peak, start, size, np.ones((len(size), len(self.langs)), bool))
        fits = np.array(grams) * self.background <= likely + self.evidence
        order = np.argsort(-full, axis=1, kind="stable")
        cost = self.penalty * np.log(size + 1.0)
        best = single.argmax(1)
        parts = np.zeros_like(full)
        parts[np.arange(len(size)), best] = 1
        value = single.max(1) - cost
        # Sets of the k most frequent languages, for documents whose mixture could be worth more than one language.
        for k in range(2, len(self.langs) + 1):
            open_ = np.flatnonzero(likely - k * cost > value)
            if not len(open_):
                break
            chosen = np.zeros((len(open_), len(self.langs)), bool)
            np.put_along_axis(chosen, order[open_, :k], True, axis=1)
            at = np.concatenate([np.arange(start[d], start[d] + size[d]) for d in open_])
            sizes = size[open_]
            tried, got = self._mixture(share[at], peak[at], np.cumsum(sizes) - sizes, sizes, chosen)
            better = got - k * cost[open_] > value[open_]
            value[open_[better]] = (got - k * cost[open_])[better]
            parts[open_[better]] = tried[better]
        for n, i in enumerate(kept):
            top = int(parts[n].argmax())
            score = float(parts[n, top])
            if (parts[n] > 0).sum() == 1:  # one language: how surely its words are that language's, by the full mixture
                score = float(full[n, top])
            out[i] = (self.langs[top], min(1.0, max(0.0, score)), [(self.langs[j], float(parts[n, j])) for j in np.flatnonzero(parts[n] > 0)], bool(fits[n]))
        return out


_MIX = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], penalty: float = 3.0, rounds: int = 6, strictness: float = 0.6, evidence: float = 60.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, languages, fits): languages an array of (lang, share), the selected set."""
    rows = pick(docs, id_col, text_col, binary=False)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS numbers

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture = MixtureModel(*shared.value, penalty, rounds, strictness, evidence)
        for ids, texts in text_blocks(batches):
            found = mixture.predict(texts)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([[{"lang": a, "share": b} for a, b in x[2]] for x in found], _MIX), pa.array([x[3] for x in found], pa.bool_())],
                names=["id", "lang_pred", "score", "languages", "fits"],
            )

    mix = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", mix), T.StructField("fits", T.BooleanType())])
    return rows.mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_on(docs: DataFrame, sample_docs: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """A model from the text and language of the documents that are not held out."""
    labelled = docs.filter(~held_out(id_col) & F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    return train(labelled.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")), sample_docs)


def keep_identified(docs: DataFrame, model: tuple[list[str], np.ndarray], penalty: float = 3.0, rounds: int = 6, strictness: float = 0.6, evidence: float = 60.0, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, in one or more of the model's languages; texts that are "und" or don't fit go. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture = MixtureModel(*shared.value, penalty, rounds, strictness, evidence)
        for part in parts_of(batches, text_col):
            found = mixture.predict(part.column(part.schema.get_field_index(text_col)).to_pylist())
            yield part.filter(pa.array([x[0] != UNDETERMINED and x[3] for x in found], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
