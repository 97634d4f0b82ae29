"""Repair of model outputs that should be JSON: clean rows are found in the JVM, only the others go through Python.

A broken text is read as a list of tokens (strings, blanks, the six marks, and words), and each repair is a rule on a token
and its neighbours, so nothing inside a string is ever looked at.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwork.functions.text import let
from groundwork.operators.lineage import small_batches

_SCAN = re.compile(r'(?s)(?P<string>"[^"\\]*+(?:\\.[^"\\]*+)*+"?)|(?P<blank>\s+)|(?P<mark>[{}\[\],:])|(?P<word>[^\s{}\[\],:"]+)|(?P<odd>.)')
#: Characters that may follow the three ticks of a fence.
_TAG = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_+-")
# The names of the repairs, and the words of another language for JSON's.
_JSON_WORD = {"True": "true", "False": "false", "None": "null"}


class Token(NamedTuple):
    kind: str
    text: str


def tokens_of(text: str, at: int = 0) -> Iterator[Token]:
    return (Token(m.lastgroup, m[0]) for m in _SCAN.finditer(text, at))


def balanced_json(text: str) -> str | None:
    """The first balanced object or array; brackets inside its strings don't count."""
    at = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if at < 0:
        return None
    pair, depth, end = {"{": 1, "}": -1} if text[at] == "{" else {"[": 1, "]": -1}, 0, at
    for token in tokens_of(text, at):
        end += len(token.text)
        depth += pair.get(token.text, 0)
        if not depth:
            return text[at:end]
    return None


def unfenced(text: str) -> str:
    """What stands between a first line of three ticks and a tag, and three ticks at the end; else the text."""
    head, line, rest = text.strip().partition("\n")
    body = rest.rstrip()
    tag = head.rstrip()[3:]
    return body[:-3].strip() if line and head.startswith("```") and body.endswith("```") and _TAG.issuperset(tag) else text


def _is_name(word: str) -> bool:
    """Letters, digits, _ and - of ASCII, and Han characters; no digit or - at the start."""
    han = lambda c: "\u4e00" <= c <= "\u9fff"
    plain = lambda c: c.isascii() and (c.isalnum() or c == "_")
    return not (word[0].isdecimal() or word[0] == "-") and all(han(c) or plain(c) or c == "-" for c in word)


class _Around:
    """A text's tokens, and for each place the nearest tokens that aren't blanks."""

    def __init__(self, text: str):
        self.all = list(tokens_of(text))
        self.solid = [i for i, t in enumerate(self.all) if t.kind != "blank"]

    def triples(self) -> Iterator[tuple[int, Token | None, Token, Token | None]]:
        """(place, token before, token, token after), blanks left out."""
        near = [None, *(self.all[i] for i in self.solid), None]
        return ((i, near[k], near[k + 1], near[k + 2]) for k, i in enumerate(self.solid))


def _written(tokens: Iterable[Token]) -> str:
    return "".join(t.text for t in tokens)


def quote_names(text: str) -> str:
    """A name after an opening brace or a comma and before a colon gets quotes."""
    around = _Around(text)
    for i, before, token, after in around.triples():
        if token.kind == "word" and before and before.text in ("{", ",") and after and after.text == ":" and _is_name(token.text):
            around.all[i] = Token("string", json.dumps(token.text, ensure_ascii=False))
    return _written(around.all)


def drop_last_commas(text: str) -> str:
    """Commas right before a closing mark go, with the blanks between."""
    kept: list[Token] = []
    for token in tokens_of(text):
        if token.text in ("}", "]"):
            solid = len(kept)
            while solid and (kept[solid - 1].kind == "blank" or kept[solid - 1].text == ","):
                solid -= 1
            comma = next((i for i in range(solid, len(kept)) if kept[i].text == ","), len(kept))
            del kept[comma:]
        kept.append(token)
    return _written(kept)


def add_commas(text: str) -> str:
    """Between the end of a value (a string, a closing mark, a digit) and a string before a colon belongs a comma."""
    around = _Around(text)
    ends = lambda t: t.kind == "string" or t.text in ("}", "]") or (t.kind == "word" and t.text[-1].isdecimal())
    gaps = {i for i, before, token, after in around.triples() if token.kind == "string" and after and after.text == ":" and before and ends(before)}
    out: list[Token] = []
    for i, token in enumerate(around.all):
        if i in gaps:
            if out[-1].kind == "blank":
                out.pop()
            out.append(Token("mark", ","))
        out.append(token)
    return _written(out)


def json_words(text: str) -> str:
    """True, False and None that touch no string become JSON's words."""
    tokens = list(tokens_of(text))
    string = lambda i: 0 <= i < len(tokens) and tokens[i].kind == "string"
    return "".join(_JSON_WORD[t.text] if t.text in _JSON_WORD and not string(i - 1) and not string(i + 1) else t.text for i, t in enumerate(tokens))


#: What is done to a text that isn't JSON, in order, until it is.
_STEPS: tuple[tuple[str, Callable[[str], str]], ...] = (
    ("stripped_bom", lambda t: t.removeprefix("\ufeff")),
    ("stripped_code_fence", unfenced),
    ("extracted_json_object", lambda t: balanced_json(t) or t),
    ("quoted_bare_keys", quote_names),
    ("removed_trailing_commas", drop_last_commas),
    ("inserted_missing_commas", add_commas),
    ("normalized_python_literals", json_words),
)


def repaired(raw: str | None) -> tuple[str | None, str, str | None]:
    """(payload as JSON text, repairs joined by ",", error). Repairs go on until the text is JSON; errors never quote it."""
    text = (raw or "").strip()
    if not text:
        return None, "", f"empty output (length {len(raw or '')})"
    done: list[str] = []
    for name, step in (("", lambda t: t), *_STEPS):
        new = step(text)
        if name and new == text:
            continue
        text = new
        done += [name] if name else []
        try:
            json.loads(text)
        except ValueError as e:
            error = f"{getattr(e, 'msg', 'no JSON')} @ line {getattr(e, 'lineno', 0)} column {getattr(e, 'colno', 0)} (length {len(raw or '')})"
        else:
            return text, ",".join(done), None
    return None, ",".join(done), error


#: What Unicode counts as white space.
_WHITE = " \t\n\x0b\x0c\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_REPAIRED = T.StructType([T.StructField(name, T.StringType()) for name in ("payload", "repairs", "parse_error")])
#: Characters of the texts that are repaired before the results are handed back.
_BLOCK_CHARS = 1 << 20


@F.arrow_udf(_REPAIRED)
def _repaired(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Repairs of the texts that aren't null. A batch is taken text by text, so that only its results are held beside it."""
    for texts in parts:
        columns: list[list[pa.Array]] = [[], [], []]
        held: list[tuple] = []
        size = 0
        for i in range(len(texts)):
            text = texts[i].as_py()
            held.append((None, None, None) if text is None else repaired(text))
            size += len(text or "")
            if size >= _BLOCK_CHARS or i == len(texts) - 1:
                for column, values in zip(columns, zip(*held)):
                    column.append(pa.array(values, pa.string()))
                held, size = [], 0
        joined = [pa.concat_arrays(c) if c else pa.array([], pa.string()) for c in columns]
        yield pa.StructArray.from_arrays(joined, _REPAIRED.names)


def repair_outputs(outputs: DataFrame, raw_col: str = "raw_output") -> DataFrame:
    """outputs with payload (JSON text), repairs and parse_error. Rows that Spark can parse as they are have nothing sent to Python,
    of the others only the text; all are read once, and a text is trimmed and parsed once."""
    small_batches(outputs.sparkSession)
    raw = F.coalesce(raw_col, F.lit(""))
    # A column of one row's generator: neither a filter nor a projection above it makes it again.
    clean = let(F.trim(raw, F.lit(_WHITE)), lambda t: F.when(F.call_function("try_parse_json", t).isNotNull(), t))
    rows = outputs.select("*", F.explode(F.array(clean)).alias("__clean"))
    rows = rows.withColumn("__r", _repaired(F.when(F.col("__clean").isNull(), raw)))
    told = {"payload": F.coalesce("__clean", "__r.payload"), "repairs": F.when(F.col("__clean").isNotNull(), "").otherwise(F.col("__r.repairs")), "parse_error": F.col("__r.parse_error")}
    return rows.withColumns(told).drop("__clean", "__r")


def repair_report(repaired_outputs: DataFrame) -> DataFrame:
    """(repair, n): how often each repair was made; clean and failed rows have lines of their own."""
    kinds = F.when(F.col("parse_error").isNotNull(), F.array(F.lit("failed"))).when(F.col("repairs") == "", F.array(F.lit("clean"))).otherwise(F.split("repairs", ","))
    return repaired_outputs.select(F.explode(kinds).alias("repair")).groupBy("repair").agg(F.count("*").alias("n"))
