"""Runs of words that repeat with a period, found by a sparse DP over diagonals.

A diagonal is a lag: how far back a word is compared with. Word by word, each earlier occurrence that a word has raises the
match length of its lag by one; a lag that isn't raised has ended, and emits a run at once if its stretch is long enough.

Sparse: an earlier occurrence counts only if it is the nearest one of the word together with the k - 1 words before it, at a
lag of more than k / 2 and at most k, for k = 1, 2, 4, ... No run is lost by that. In a stretch with smallest period q and
four times that length, let k be the power of two with k / 2 < q <= k. Any k words in it stand again q words earlier; if
they stood again nearer, at d, then k + d >= q + d words would have both periods, so their greatest common divisor, and the
stretch would have a smaller period than q. So each position from the (q + k)-th of the stretch on raises lag q, those of
a stretch whose smallest period divides q never do, and a word has at most one lag for each k: a text of n equal words
takes n steps, not n * n. The occurrences of k words are named from those of k / 2 words, where these repeat at all.

Texts are independent, so there is no shuffle. A null or empty text has no words and no runs. Texts are taken whole; a task
holds a block of texts, or one text. Repeated rows give repeated results; a null id is kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from groundwork.llm.bpe import Numbered
from groundwork.llm.common import pick, text_blocks, tidy

#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 6, 4


def occurrences(words: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, positions, lags), k = 1, 2, 4, ...: where the k words that end at a position stand again, nearest, at a lag within
    (k / 2, k]. words: numbers of words, texts end to end; text: the number of each word's text, ascending."""
    n = len(words)
    at = np.arange(n)
    same = lambda lag: np.concatenate((np.zeros(min(lag, n), bool), (words[lag:] == words[:-lag]) & (text[lag:] == text[:-lag])))
    one = same(1)
    yield 1, at[one], np.ones(one.sum(), np.int64)
    two = same(2)
    both = two.copy()
    both[1:] &= two[:-1]
    both[:1] = False
    both &= ~one
    yield 2, at[both], np.full(both.sum(), 2)
    # names: which k words end at a position, -1 for those that stand nowhere else in their text
    names = np.full(n, -1)
    inner = np.flatnonzero(text[1:] == text[:-1]) + 1
    _, kind = np.unique(words * (int(text.max(initial=0)) + 1) + text, return_inverse=True)  # words of a text
    _, kind, times = np.unique(kind[inner - 1] * (int(kind.max(initial=0)) + 1) + kind[inner], return_inverse=True, return_counts=True)
    names[inner] = np.where(times[kind] > 1, kind, -1)
    k = 2
    while True:
        end = np.flatnonzero(names[k:] >= 0) + k
        end = end[names[end - k] >= 0]
        end = end[text[end] == text[end - k]]
        if not len(end):
            return
        key = names[end - k] * (int(names.max()) + 1) + names[end]
        k *= 2
        order = np.argsort(key, kind="stable")
        end, key = end[order], key[order]
        again = np.flatnonzero(key[1:] == key[:-1]) + 1
        lag = end[again] - end[again - 1]
        fits = (lag > k // 2) & (lag <= k)
        yield k, end[again][fits], lag[fits]
        repeats = np.zeros(len(end), bool)
        repeats[again] = repeats[again - 1] = True
        first = np.concatenate(([True], key[1:] != key[:-1]))
        names = np.full(n, -1)
        names[end[repeats]] = np.cumsum(first)[repeats]


def diagonal_runs(events: Iterable[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of each run, as it ends. events: (position, lag, k) in order of position. A text's first word
    has none, so no diagonal goes on into another text."""
    last, active, raised = -2, {}, {}  # match lengths of lags: those of the position before the last one, and of the last one

    def emit(lags: dict[int, int], end: int) -> Iterator[tuple[int, int, int]]:
        for lag, matched in lags.items():
            if matched + lag >= max(LEAST, TIMES * lag):
                yield end - matched - lag, matched + lag, lag

    for position, lag, k in events:
        if position != last:
            yield from emit(active, last)  # what the last position hasn't raised
            active = raised
            if position != last + 1:
                yield from emit(active, last + 1)
                active = {}
            last, raised = position, {}
        raised[lag] = active.pop(lag, k - 1) + 1
    yield from emit(active, last)
    yield from emit(raised, last + 1)


def block_runs(texts: list[bytes]) -> tuple[list[list[bytes]], list[list[tuple[int, int, int]]]]:
    """The words of each text, and its runs by (start, period)."""
    number, words, flat = Numbered(), [], []
    for t in texts:
        ws = t.split()  # at the bytes 0x20 and 0x09 to 0x0D
        words.append(ws)
        flat.append(np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)))
    sizes = np.array([len(ws) for ws in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(texts)), sizes)
    found = [(p, lags, np.full(len(p), k)) for k, p, lags in occurrences(np.concatenate(flat) if flat else np.array([], np.int64), text)] if len(text) else []
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if found:
        at, lags, ks = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(at, kind="stable")
        for start, length, period in diagonal_runs(zip(at[order].tolist(), lags[order].tolist(), ks[order].tolist())):
            of = int(text[start])
            runs[of].append((start - int(starts[of]), length, period))
    for some in runs:
        some.sort(key=lambda r: (r[0], r[2]))
    return words, runs


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, one space between two."""
    if not runs:
        return b" ".join(words)
    out, kept = [], 0
    for first, end in sorted((start + period, start + length) for start, length, period in runs):
        if first > kept:
            out += words[kept:first]
        kept = max(kept, end)
    return b" ".join(out + words[kept:])


_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed): runs are structs (start, length, period) by start and period, words counted from 0;
    collapsed is the text without the repetitions. A stretch of words is a run if its smallest period fits four times and it
    has six words. One row for each row; other columns of docs don't matter."""
    rows = pick(docs, id_col, text_col)
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_blocks(batches):
            words, runs = block_runs(texts)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(ws) for ws in words], pa.int64()), pa.array([[dict(zip(("start", "length", "period"), r)) for r in some] for some in runs], run_type), pa.array([collapsed(ws, some).decode() for ws, some in zip(words, runs)], pa.string())],
                names=["id", "n_words", "runs", "collapsed"],
            )

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)
