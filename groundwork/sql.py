"""The library's functions under names for SQL: register(spark), then `SELECT text_fold(title) ...`.

| Name | Gives |
|-|-|
| text_normalize(text) | NFKC, without zero-width and control characters, whitespace runs as one space, trimmed; null is empty |
| text_fold(text) | NFKC and casefold, whitespace as it is; null is empty |
| content_fingerprint(source, title, author, description, raw_text) | SHA-256 of the normalised fields, in hex |
| number_tokens(text) | a table (ord, raw, value, kind, scale, fuzzy) for each text: use it with LATERAL |

The three scalar functions take and give Arrow arrays, the table function is fed and read in Arrow batches. In DataFrame code
the column expressions of groundwork.functions.text do the same and keep ASCII in the JVM.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from decimal import Context, Decimal

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwork.functions.text import SEPARATOR
from groundwork.operators.lineage import small_batches
from groundwork.operators.numbers import LIMIT, TOKEN, number_tokens

_DROPPED = re.compile(r"[\u200b-\u200f\u2028\u2029\ufeff\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_BLANK = re.compile(r"[\t\n\r \x85\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]+")


def _normalized(text: str | None) -> str:
    if not text:
        return ""
    return _BLANK.sub(" ", _DROPPED.sub("", text if text.isascii() else unicodedata.normalize("NFKC", text))).strip(" ")


def _texts(values: list) -> pa.Array:
    return pa.array(values, pa.string())


@F.arrow_udf(T.StringType())
def text_normalize(text: pa.Array) -> pa.Array:
    return _texts([_normalized(x) for x in text.to_pylist()])


@F.arrow_udf(T.StringType())
def text_fold(text: pa.Array) -> pa.Array:
    return _texts([unicodedata.normalize("NFKC", x or "").casefold() for x in text.to_pylist()])


@F.arrow_udf(T.StringType())
def content_fingerprint(source: pa.Array, title: pa.Array, author: pa.Array, description: pa.Array, raw_text: pa.Array) -> pa.Array:
    rows = zip(*(x.to_pylist() for x in (source, title, author, description, raw_text)))
    return _texts([hashlib.sha256(SEPARATOR.join(map(_normalized, row)).encode()).hexdigest() for row in rows])


_PLACES, _DIGITS = Decimal(1).scaleb(-10), Context(prec=50)


class NumberTokens:
    def eval(self, text: str | None) -> Iterator[tuple]:
        for i, (raw, value, kind, scale, fuzzy) in enumerate(number_tokens(text or "")):
            yield i, raw, value.quantize(_PLACES, context=_DIGITS) if abs(value) < LIMIT else None, kind, scale, fuzzy


number_table = F.udtf(NumberTokens, returnType=TOKEN, useArrow=True)


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL, and cuts the batches that they get by their bytes."""
    small_batches(spark)
    for function in (text_normalize, text_fold, content_fingerprint):
        spark.udf.register(function.__name__, function)
    spark.udtf.register("number_tokens", number_table)
