"""Number tokens of texts, and whether the numbers of a claim stand in its source."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions.text import wide

# Chinese numerals, units inside a number, units of magnitude, marks of a rough number, the words before a
# percentage, and the most characters that a written-out number has.
DIGITS = {"零": 0, "〇": 0, "一": 1, "壹": 1, "二": 2, "两": 2, "贰": 2, "三": 3, "叁": 3, "四": 4, "肆": 4, "五": 5, "伍": 5, "六": 6, "陆": 6, "七": 7, "柒": 7, "八": 8, "捌": 8, "九": 9, "玖": 9}
SMALL = {"十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000}
BIG = {"万": 10**4, "亿": 10**8}
ROUGH = "多余左右"
ARABIC_SCALE = {"百": 100, "千": 1000, **BIG}
OF_HUNDRED = "百分之"
LONGEST = 12

_HAN = "".join(sorted({*DIGITS, *SMALL, *BIG}))
_FIRST = re.compile(rf"\d|[{_HAN}]")
_AT_BIG, _AT_SMALL = re.compile(f"([{''.join(BIG)}])"), re.compile(f"([{''.join(SMALL)}])")
#: Numbers that a decimal(38,10) can't hold have no value.
LIMIT = 10**27

TOKEN = "ord int, raw string, value decimal(38,10), kind string, scale long, fuzzy boolean"


def _below_myriad(text: str) -> int:
    """A stretch without magnitudes: each unit times the digit right before it, or once; then the last digit."""
    *counted, rest = _AT_SMALL.split(text)
    last = lambda digits: DIGITS[digits[-1]] if digits else 0
    return sum((last(n) or 1) * SMALL[unit] for n, unit in zip(counted[::2], counted[1::2])) + last(rest)


def han_value(text: str) -> int:
    """Every magnitude multiplies the stretch before it, or one; what follows the last magnitude is added."""
    *counted, rest = _AT_BIG.split(text)
    return sum((_below_myriad(n) or 1) * BIG[unit] for n, unit in zip(counted[::2], counted[1::2])) + _below_myriad(rest)


class _Reader:
    """Reads numerals off a text from left to right; what is read as a percentage is blanked out for what comes after."""

    def __init__(self, text: str):
        self.text = text

    def while_in(self, at: int, chars: str, most: int) -> int:
        """The end of the run of at most `most` of these characters that starts at a place."""
        end = at
        while end < min(len(self.text), at + most) and self.text[end] in chars:
            end += 1
        return end

    def digits(self, at: int) -> int:
        while at < len(self.text) and self.text[at].isdecimal():
            at += 1
        return at

    def blanks(self, at: int) -> int:
        while at < len(self.text) and self.text[at].isspace():
            at += 1
        return at

    def arabic(self, at: int) -> int:
        """The end of a number in digits, its decimal places included."""
        end = self.digits(at)
        if end == at:
            return at
        places = self.digits(end + 1) if self.text[end : end + 1] == "." else end + 1
        return places if places > end + 1 else end

    def percents(self) -> Iterator[tuple]:
        """What follows the words for "of a hundred", then what stands before a percent sign, both from left to right."""
        spans, at = [], self.text.find(OF_HUNDRED)
        while at >= 0:
            start = self.blanks(at + len(OF_HUNDRED))
            spelled = self.while_in(start, _HAN, LONGEST)
            end = max(self.arabic(start), spelled)
            if end > start:
                number = self.text[start:end]
                spans.append((at, end, Decimal(han_value(number) if spelled > start else number)))
            at = self.text.find(OF_HUNDRED, end if end > start else at + 1)
        yield from self._blanked(spans)
        spans, done, sign = [], 0, -1
        while (sign := self.text.find("%", sign + 1)) >= 0:
            end = sign
            while end > done and self.text[end - 1].isspace():
                end -= 1
            start = self._back(end, done)
            if start < end and start > done and self.text[start - 1] == "." and (whole := self._back(start - 1, done)) < start - 1:
                start = whole
            if start < end:
                spans.append((start, sign + 1, Decimal(self.text[start:end])))
            done = sign + 1
        yield from self._blanked(spans)

    def _back(self, end: int, least: int) -> int:
        while end > least and self.text[end - 1].isdecimal():
            end -= 1
        return end

    def _blanked(self, spans: list[tuple]) -> Iterator[tuple]:
        left, done = [], 0
        for at, end, value in spans:
            yield self.text[at:end], value, "percent", 1, False
            left += [self.text[done:at], " " * (end - at)]
            done = end
        self.text = "".join([*left, self.text[done:]])

    def plain(self) -> Iterator[tuple]:
        at = 0
        while m := _FIRST.search(self.text, at):
            start, c = m.start(), m[0]
            if c.isdecimal():
                at = end = self.arabic(start)
                unit = self.text[self.blanks(end) : self.blanks(end) + 1]
                scale = ARABIC_SCALE.get(unit, 1)
                if scale > 1:
                    at = self.blanks(end) + 1
                yield self.text[start:at].strip(), Decimal(self.text[start:end]) * scale, "plain", scale, False
                continue
            end = self.while_in(start, _HAN, LONGEST)
            rough = self.while_in(end, ROUGH, 2)
            at = self.while_in(rough, "".join(BIG), 1)
            number, tail = self.text[start:end], BIG.get(self.text[rough:at], 1)
            if len(number) > 1:  # a numeral alone is a word more often than a number
                scale = max((BIG[c] for c in number if c in BIG), default=1) * tail
                yield self.text[start:at].strip(), Decimal(han_value(number) * tail), "plain", scale, rough > end


def number_tokens(text: str) -> list[tuple]:
    """(raw, value, kind, scale, fuzzy): percentages first, then the other numbers, each in the order of the text."""
    reader = _Reader(unicodedata.normalize("NFKC", text or "").casefold())
    return [*reader.percents(), *reader.plain()]


def extract_numbers(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, ord, raw, value, kind, scale, fuzzy): one row for each number of each text. Texts without a digit never reach Python.

    A number of 10^27 and more has a null value, as a decimal(38,10) can't hold it; its raw text is kept.
    """
    text = F.col(text_col)
    # The digits of ASCII stop the search in most texts; the large class is only tried where a character lies outside ASCII.
    some = rows.filter(text.rlike("[0-9]") | (wide(text) & text.rlike(rf"(?=[^\x00-\x7F])[\p{{Nd}}{_HAN}]"))).select(*keys, text_col)
    fields = ", ".join(f"{k} {some.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(*row[:-1], i, t[0], t[1] if t[1] < LIMIT else None, *t[2:]) for row in batch.itertuples(index=False, name=None) for i, t in enumerate(number_tokens(row[-1]))]
            out = pd.DataFrame(found, columns=[*keys, "ord", "raw", "value", "kind", "scale", "fuzzy"])
            for k in keys:
                out[k] = out[k].astype(batch[k].dtype)
            yield out.astype({"ord": "int32", "scale": "int64", "fuzzy": "bool"})

    return some.mapInPandas(run, f"{fields}, {TOKEN}")


def arabic_numbers(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, ord, value): plain and percent numbers in Arabic digits, by DataFrame functions alone."""
    found = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    return rows.select(*keys, F.posexplode(found).alias("ord", "raw")).select(*keys, "ord", F.col("raw").cast("decimal(38,10)").alias("value"))


def is_key(value: Column, kind: Column, scale: Column) -> Column:
    return (kind == "percent") | (scale > 1) | F.coalesce(F.abs(value) >= 10, F.lit(True))


def ungrounded(claims: DataFrame, sources: DataFrame, key: str, claim_key: list[str]) -> DataFrame:
    """The claim numbers that no source number of the same key and kind matches.

    Equal values match; if either number is rough, so do values that differ by at most 15 % of the claim's; 0 only 0. Numbers
    without a value match if they are written alike.
    The key and the kind are equi keys, so the band is checked inside a hash or merge join only.
    """
    c = claims.select(*claim_key, key, "ord", "raw", "value", "kind", "fuzzy")
    s = sources.select(F.col(key).alias("__key"), F.col("kind").alias("__kind"), F.col("value").alias("__value"), F.col("fuzzy").alias("__fuzzy"), F.when(F.col("value").isNull(), F.col("raw")).alias("__raw")).distinct()
    near = (F.abs(F.col("value") - F.col("__value")) * 100 <= F.abs("value") * 15) & ((F.col("value") != 0) | (F.col("__value") == 0))
    same = (F.col(key) == F.col("__key")) & (F.col("kind") == F.col("__kind"))
    alike = F.coalesce(F.col("value") == F.col("__value"), F.col("value").isNull() & (F.col("raw") == F.col("__raw")), F.lit(False))
    return c.join(s, same & (alike | (F.coalesce((F.col("fuzzy") | F.col("__fuzzy")) & near, F.lit(False)))), "left_anti")
