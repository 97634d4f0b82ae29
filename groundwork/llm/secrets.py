"""Secret scans: fixed patterns, and formats learned by grammar inference.

The fixed patterns find labelled credentials (kind, value). A bounded sample of them, the sample_size distinct values of
each kind with the smallest hashes among those of at most max_value characters, goes to the driver, where each kind's
prefix tree over character classes is folded into a probabilistic automaton (see Automaton); a kind with fewer than EVIDENCE
values teaches none. All distinct unlabelled runs of the corpus, whole, teach how likely a run is that is
no secret: Spark counts which class follows which, so that 132 sums come to the driver. Both are small and go to every task, which scores all credential-like runs of a text: a run is a span too if an
automaton gives it at all, about as likely as its own values, and more likely than the background by the margin. So identifiers of another make (UUIDs, hashes of another length, versions, dates) stay, however random. What is
credential-like follows from the sample: a run is as long as the shortest value that an automaton has learned (from 8
characters; 16 are always enough), and has a digit where all of them have. Of a run that a fixed pattern covers in part, what is
left on either side is scored by itself, and so are the parts between equals signs of a run that has no format as a whole.

Null and empty texts have no spans. Texts are scanned whole, in one pass. Places are code points, ends exclusive. Repeated
rows repeat their results, and a value counts once for the sample however many rows hold it.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwork.llm.common import checkpointed, parts_of, pick, text_blocks, tidy

# The patterns of labelled credentials, and the least length of what counts.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal either way, so shorter ones need not match
KINDS = ("assign", "access", "hex")
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: Values that a state needs before it counts for a merge, and a kind before it teaches a format.
EVIDENCE = 16
#: How much less likely than its least likely value, a character, a run may be; characters that plain words count in the background.
TYPICAL, PRIOR = 0.25, 200.0
#: How many nats a run must be likelier as a secret than as anything else.
MARGIN = 5.0

#: Lengths from which a run may be, and always is, long enough for a learned format.
SHORT, LONG = 8, 16

#: Character classes are the automata's alphabet: digits, a-f, g-z, A-F, G-Z, and the other characters by themselves.
_CLASS = {c: n for n, s in enumerate(("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-")) for c in s}
_SIZE = [10, 6, 20, 6, 20, 1, 1, 1, 1, 1, 1]


_DIGIT, _LETTER = re.compile(r"[0-9]").search, re.compile(r"[A-Za-z]").search


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the fixed patterns, by start, then kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(0, m.start(), m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), m.group()) for m in ACCESS.finditer(text) if len(m.group()) >= LEAST["access"]]
    out += [(2, m.start(), m.end(), m.group()) for m in HEX.finditer(text)]
    return [(KINDS[k], a, b, v) for a, k, b, v in sorted((a, k, b, v) for k, a, b, v in out)]


def covered(base: list[tuple[str, int, int, str]]) -> tuple[list[int], list[int]]:
    """(starts, ends) of what the fixed patterns cover, merged."""
    starts: list[int] = []
    ends: list[int] = []
    for _, a, b, _ in base:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _classes(value: str) -> list[int] | None:
    out = [_CLASS.get(c, -1) for c in value]
    return None if -1 in out else out


class Automaton:
    """A probabilistic automaton over character classes, folded from the prefix tree of a sample.

    The tree's nodes that at least EVIDENCE values go through, and a tenth of all, are states of their own; of what hangs below
    such a node, all nodes of one depth are one state, so that order and length survive where values are too few to tell
    more. Then states are merged, those with most values first, if their frequencies and those of all their successors
    are compatible by a Hoeffding bound; a state with fewer values than EVIDENCE is merged only with one of its own depth.
    """

    def __init__(self, values: list[str], alpha: float = 0.001):
        self.alpha = alpha
        self.least = max(SHORT, min([LONG, *map(len, values)]))
        self.digit, self.letter = all(map(_DIGIT, values)), all(map(_LETTER, values))  # whether all values have one
        sample = [x for v in values if (x := _classes(v))]
        through = Counter(tuple(x[:n]) for x in sample for n in range(len(x) + 1))
        enough = max(EVIDENCE, len(sample) // 10)
        number: dict[tuple, int] = {}
        self.depth: list[int] = []
        self.edges: list[dict[int, int]] = []
        self.through: list[Counter] = []
        self.final: list[int] = []

        def state(key: tuple, depth: int) -> int:
            if key not in number:
                number[key] = len(self.edges)
                self.depth.append(depth)
                self.edges.append({})
                self.through.append(Counter())
                self.final.append(0)
            return number[key]

        state(((), 0), 0)
        for x in sample:
            at, anchor = 0, 0
            for n, c in enumerate(x, 1):
                if anchor == n - 1 and through[tuple(x[:n])] >= enough:
                    anchor = n
                to = state((tuple(x[:anchor]), n), n)
                self.through[at][c] += 1
                self.edges[at][c] = to
                at = to
            self.final[at] += 1
        self._merge()
        means = [m for x in sample if (m := self.score(x)) is not None]
        self.floor = min(means, default=0.0) - TYPICAL

    def _total(self, s: int) -> int:
        return self.final[s] + sum(self.through[s].values())

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return n > 0 < m and abs(a / n - b / m) > (1 / math.sqrt(n) + 1 / math.sqrt(m)) * math.sqrt(0.5 * math.log(2 / self.alpha))

    def _now(self, s: int) -> int:
        while self.merged[s] != s:
            s = self.merged[s]
        return s

    def _compatible(self, red: int, blue: int) -> bool:
        if min(self._total(red), self._total(blue)) < EVIDENCE and self.depth[red] != self.depth[blue]:
            return False
        todo, seen = [(red, blue)], {(red, blue)}
        while todo:
            r, b = todo.pop()
            n, m = self._total(r), self._total(b)
            if self._differ(self.final[r], n, self.final[b], m) or any(self._differ(self.through[r][c], n, self.through[b][c], m) for c in {*self.edges[r], *self.edges[b]}):
                return False
            for c in self.edges[r].keys() & self.edges[b].keys():
                pair = self._now(self.edges[r][c]), self._now(self.edges[b][c])
                if pair[0] != pair[1] and pair not in seen:
                    seen.add(pair)
                    todo.append(pair)
        return True

    def _fold(self, red: int, blue: int) -> None:
        todo = [(red, blue)]
        while todo:
            r, b = map(self._now, todo.pop())
            if r == b:
                continue
            self.merged[b] = r
            self.final[r] += self.final[b]
            self.through[r] += self.through[b]
            for c, to in self.edges[b].items():
                if c in self.edges[r]:
                    todo.append((self.edges[r][c], to))
                else:
                    self.edges[r][c] = to

    def _merge(self) -> None:
        self.merged = list(range(len(self.edges)))
        reds = [0]
        while True:
            reds = list(dict.fromkeys(map(self._now, reds)))
            blues = sorted({(-self._total(x), self.depth[x], x) for r in reds for to in self.edges[r].values() if (x := self._now(to)) not in reds})
            if not blues:
                break
            blue = blues[0][2]
            into = next((x for x in reds if self._compatible(x, blue)), None)
            if into is None:
                reds.append(blue)
            else:
                self._fold(into, blue)
        order = {s: i for i, s in enumerate(reds)}
        self.states = [({c: (order[self._now(to)], math.log((self.through[s][c] + 0.1) / (self._total(s) + 1.2) / _SIZE[c])) for c, to in self.edges[s].items()}, math.log((self.final[s] + 0.1) / (self._total(s) + 1.2)) if self.final[s] else None) for s in reds]
        del self.edges, self.through, self.final, self.depth, self.merged

    def score(self, classes: list[int]) -> float | None:
        """Mean log-likelihood of a character; None for what the automaton never gives: a class that no value has had there, or
        an end where none has ended."""
        at, total = 0, 0.0
        for c in classes:
            step = self.states[at][0].get(c)
            if step is None:
                return None
            at, total = step[0], total + step[1]
        end = self.states[at][1]
        return None if end is None else (total + end) / (len(classes) + 1)


#: Shares of the classes in plain text: mostly lower-case letters. What the unlabelled runs of the corpus add to these counts.
_PLAIN = (0.02, 0.28, 0.6, 0.02, 0.03, 0.005, 0.005, 0.01, 0.02, 0.005, 0.01)


#: What a character of a run counts in the background; a run longer than the longest value that can be learned counts as much as one of that length.
_UNIT, _WHOLE = 1 << 16, 256


def followers(runs: Iterable[str]) -> Counter:
    """How often each class comes after another (after the last one's number: at a run's start) in runs, in units: whole numbers, so
    that sums are the same in any order."""
    out: Counter = Counter()
    for run in runs:
        classes = _classes(run) or []
        unit = _UNIT if len(classes) <= _WHOLE else max(1, _UNIT * _WHOLE // len(classes))
        for pair, n in Counter(zip([len(_SIZE), *classes], classes)).items():
            out[pair] += n * unit
    return out


class Background:
    """How likely a run is without being a secret: class after class, as in the corpus' unlabelled runs, and plain words before these."""

    def __init__(self, runs: Iterable[str] = (), counted: Counter | None = None):
        counts = [[PRIOR * p for p in _PLAIN] for _ in range(len(_SIZE) + 1)]
        for (before, c), n in (followers(runs) if counted is None else counted).items():
            counts[before][c] += n / _UNIT
        self.logs = [[math.log(x / sum(row) / n) for x, n in zip(row, _SIZE)] for row in counts]

    def score(self, classes: list[int]) -> float:
        before, total = len(_SIZE), 0.0
        for c in classes:
            total += self.logs[before][c]
            before = c
        return total / (len(classes) + 1)


class SecretScanner:
    def __init__(self, automata: dict[str, Automaton], margin: float, background: Background | None = None):
        self.automata, self.margin, self.background = automata, margin, background or Background()
        self.least = min((a.least for a in automata.values()), default=LONG)
        digit = "(?=[A-Za-z+/_.=-]*[0-9])" if all(a.digit for a in automata.values()) else ""
        self.candidate = re.compile(f"(?<![A-Za-z0-9+/_.=-]){digit}[A-Za-z0-9+/_.=-]{{{self.least},}}")

    def likely(self, value: str) -> float:
        """How far a value's best format lies above the background, in nats; -inf if no format gives it, or none gives it as likely
        as its own values."""
        classes = _classes(value)
        if classes is None:
            return -math.inf
        scores = [x for a in self.automata.values() if len(value) >= a.least and (x := a.score(classes)) is not None and x >= a.floor]
        return (max(scores) - self.background.score(classes)) * (len(classes) + 1) if scores else -math.inf

    def formats(self, text: str, at: int, stop: int) -> Iterator[dict]:
        """The run from at to stop if it has a learned format, else the parts between its equals signs that do."""
        value = text[at:stop].rstrip(".=-/+_")
        if len(value) < self.least:
            return
        if (above := self.likely(value)) > self.margin:
            yield {"kind": "format", "first": at, "end": at + len(value), "score": 1 - math.exp(-above / 10)}
        elif "=" in value:
            for part in value.split("="):
                if len(part) >= self.least and (above := self.likely(part)) > self.margin:
                    yield {"kind": "format", "first": at, "end": at + len(part), "score": 1 - math.exp(-above / 10)}
                at += len(part) + 1

    def scan(self, text: str) -> list[dict]:
        base = base_spans(text)
        spans = [{"kind": k, "first": a, "end": b, "score": 1.0} for k, a, b, _ in base]
        starts, ends = covered(base)
        for m in self.candidate.finditer(text) if self.automata else ():
            at, n = m.start(), bisect_right(ends, m.start())
            while at < m.end():
                stop = min(m.end(), starts[n]) if n < len(starts) else m.end()
                spans += self.formats(text, at, stop)
                if stop == m.end():
                    break
                at, n = ends[n], n + 1
        rank = {k: i for i, k in enumerate((*KINDS, "format"))}
        return sorted(spans, key=lambda s: (s["first"], rank[s["kind"]], s["end"]))


_LABELLED = T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])


def labelled_credentials(docs: DataFrame, max_value: int = 256, text_col: str = "text") -> DataFrame:
    """(kind, value) of every labelled credential of the corpus with at most max_value characters."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_blocks(batches):
            found = [s for t in texts for s in base_spans(t) if len(s[3]) <= max_value]
            yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in found], pa.string()), pa.array([s[3] for s in found], pa.string())], names=["kind", "value"])

    return pick(docs.withColumn("__row", F.lit(0)), "__row", text_col, binary=False).mapInArrow(tidy(run), _LABELLED)


def infer_formats(docs: DataFrame, sample_size: int = 400, max_value: int = 256, text_col: str = "text") -> dict[str, Automaton]:
    """An automaton for each kind, from at most sample_size distinct values of it: those with the smallest hashes."""
    # Distinct values first, so that one value in most rows is one row; then only as small a share of them, by hash, as is
    # sure to hold the sample.
    values = checkpointed(labelled_credentials(docs, max_value, text_col).groupBy("kind", "value").agg(F.min(F.xxhash64("value")).alias("hash")))
    counts = values.groupBy("kind").agg(F.count("*").alias("n"))  # one row a kind
    share = F.pmod("hash", F.lit(1 << 30)) * F.col("n") <= F.lit(4.0 * sample_size + 100) * F.lit(1 << 30)
    few = values.join(F.broadcast(counts), "kind").filter(share)
    first = few.withColumn("place", F.row_number().over(W.partitionBy("kind").orderBy(F.pmod("hash", F.lit(1 << 30)), "value"))).filter(F.col("place") <= sample_size)
    sample: dict[str, list[str]] = {}
    for row in first.select("kind", "value").collect():  # at most sample_size values of three kinds
        sample.setdefault(row["kind"], []).append(row["value"])
    return {kind: Automaton(sorted(sample[kind])) for kind in sorted(sample) if len(sample[kind]) >= EVIDENCE}


_RUN = re.compile(f"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{{{SHORT},}}")


def infer_background(docs: DataFrame, text_col: str = "text", digit: bool = True) -> Background:
    """The background from all distinct unlabelled runs, those with a digit if digit says so, each whole: tasks give runs, Spark
    tells them apart and adds up which class follows which."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_blocks(batches):
            runs = set()
            for text in texts:
                found = [m for m in _RUN.finditer(text) if not digit or _DIGIT(m[0])]
                starts, ends = covered(base_spans(text)) if found else ([], [])
                runs.update(m[0].rstrip(".=-/+_") for m in found if not (n := bisect_left(starts, m.end())) or ends[n - 1] <= m.start())
            yield pa.RecordBatch.from_arrays([pa.array(sorted(runs), pa.string())], names=["run"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: Counter = Counter()
        for batch in batches:
            told.update(followers(batch.column(0).to_pylist()))
        rows = sorted(told.items())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x, _ in rows], pa.int32()) for i in (0, 1)] + [pa.array([n for _, n in rows], pa.int64())], names=["before", "class", "n"])

    runs = pick(docs.withColumn("__row", F.lit(0)), "__row", text_col, binary=False).mapInArrow(tidy(run), "run string").distinct()
    sums = runs.mapInArrow(tidy(count), "before int, class int, n long").groupBy("before", "class").agg(F.sum("n").alias("n"))
    return Background(counted=Counter({(r["before"], r["class"]): r["n"] for r in sums.collect()}))  # a row for each pair of classes


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("first", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])


def _scanner(docs: DataFrame, automata: dict[str, Automaton] | None, margin: float, sample_size: int, text_col: str, background: Background | None) -> SecretScanner:
    if automata is None:
        automata = infer_formats(docs, sample_size, text_col=text_col)
    if background is None and automata:
        background = infer_background(docs, text_col, all(a.digit for a in automata.values()))
    return SecretScanner(automata, margin, background)


def scan_secrets(docs: DataFrame, automata: dict[str, Automaton] | None = None, margin: float = MARGIN, sample_size: int = 400, id_col: str = "doc_id", text_col: str = "text", background: Background | None = None) -> DataFrame:
    """(id, spans): one row for each document; spans an array of (kind, first, end, score), by place, then kind. An empty table
    gives no rows; other columns of docs don't matter."""
    scanner = _scanner(docs, automata, margin, sample_size, text_col, background)
    rows = pick(docs, id_col, text_col, binary=False)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_blocks(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array([scanner.scan(t) for t in texts], _SPANS)], names=["id", "spans"])

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("spans", T.ArrayType(_SPAN))])
    return rows.mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)


def redact_secrets(docs: DataFrame, automata: dict[str, Automaton] | None = None, mask: str = "[SECRET]", margin: float = MARGIN, sample_size: int = 400, text_col: str = "text", background: Background | None = None) -> DataFrame:
    """The same rows and columns with every span replaced by mask; overlapping spans by one mask. Null stays null."""
    scanner = _scanner(docs, automata, margin, sample_size, text_col, background)

    def clean(text: str | None) -> str | None:
        if not text or not (spans := scanner.scan(text)):
            return text
        out, at = [], 0
        for s in spans:
            if s["first"] >= at:
                out += [text[at : s["first"]], mask]
            at = max(at, s["end"])
        return "".join([*out, text[at:]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, text_col):
            at = batch.schema.get_field_index(text_col)
            yield batch.set_column(at, text_col, pa.array([clean(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type))

    return docs.mapInArrow(tidy(run), docs.schema)
