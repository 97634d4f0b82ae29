"""Column expressions over text: normalisation, fingerprint payloads, cleaning, budgets and sentences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH_VERSION = 2
SEPARATOR = "\x1f"
#: Fields of the fingerprint, in the order in which they are joined.
HASH_FIELDS = ("source", "title", "author", "description", "raw_text")
#: Characters without width, as a pattern class.
ZERO_WIDTH = "\\u200b-\\u200f\\u2028\\u2029\\ufeff"
CONTROL = r"\x00-\x08\x0b\x0c\x0e-\x1f\x7f"


@F.pandas_udf(T.StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.str.normalize("NFKC")


@F.pandas_udf(T.StringType())
def _nfkc_casefold(x: pd.Series) -> pd.Series:
    return x.str.normalize("NFKC").str.casefold()


def wide(x: Column) -> Column:
    """Whether a text has a character outside ASCII: told by two lengths, without looking at its characters one by one."""
    return F.octet_length(x) != F.length(x)


def nfkc(x: Column) -> Column:
    """ASCII needs no Python: it stays in the JVM."""
    return F.coalesce(_nfkc(F.when(wide(x), x)), x)


#: What Unicode counts as white space: (?U)\s of a pattern.
WHITE = " \t\n\r\x0b\x0c\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Characters that count as blank at the ends of a text.
BLANKS = WHITE + "\x1c\x1d\x1e\x1f"
#: The runs of white space that are not one space already, which most of a text's runs are.
RUNS = r"(?U)\s(?:\s+|(?<! ))"


def let(value: Column, use) -> Column:
    """use(value) with value computed once, inside lambda functions too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim_all(x: Column) -> Column:
    return F.trim(x, F.lit(BLANKS))


def one_line(x: Column) -> Column:
    """All whitespace runs as one space; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), RUNS, " "))


def normalize_text(x: Column) -> Column:
    """Null is empty; NFKC; without zero-width and control characters; whitespace runs as one space; trimmed."""
    y = nfkc(F.coalesce(x.cast("string"), F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(y, f"[{ZERO_WIDTH}{CONTROL}]", ""), RUNS, " "))


def normalize_optional(x: Column) -> Column:
    return F.nullif(normalize_text(x), F.lit(""))


def is_blank(x: Column) -> Column:
    return normalize_text(x) == ""


def fold_for_matching(x: Column) -> Column:
    """NFKC and casefold; whitespace stays. ASCII needs no Python."""
    y = F.coalesce(x, F.lit(""))
    return F.coalesce(_nfkc_casefold(F.when(wide(y), y)), F.lower(y))


def hash_payload(*normalized: Column) -> Column:
    """The normalised fields of HASH_FIELDS, joined; they must not be null, as concat_ws would skip them."""
    return F.concat_ws(SEPARATOR, *normalized)


def content_hash(payload: Column) -> Column:
    return F.sha2(payload.cast("binary"), 256)


def resolve_source_id(raw: Column, digest: Column) -> tuple[Column, Column, Column]:
    """(source_id, needs_manual_review, error_type): an empty or URL-like id falls back to the fingerprint."""
    lost = (raw == "") | F.lower(raw).rlike("^(http://|https://|www\\.)")
    return (
        F.when(lost, F.concat(F.lit("hash:"), F.substring(digest, 1, 16))).otherwise(raw),
        lost,
        F.when(lost, F.lit("SOURCE_ID_RESOLUTION_FAILED")),
    )


def _zero_width_free(x: Column) -> Column:
    return F.when(wide(x), F.regexp_replace(x, f"[{ZERO_WIDTH}]", "")).otherwise(x)  # all of them lie outside ASCII


def clean_source_text(x: Column) -> Column:
    """struct(text, newline_normalized, zero_width_removed, duplicate_lines_removed, blank_lines_collapsed).

    A blank line goes if the two lines before it are blank; a line goes if it repeats the line directly before it. Both
    rules look at neighbours only, so no line depends on what was decided for another.
    """

    def judged(lines: Column, bare: Column) -> Column:
        """Keeps (line, blank, twice) of each line; bare has the lines without blanks around them."""
        before = lambda i, k, other: F.when(i >= k, F.get(bare, i - k)).otherwise(other)
        return F.zip_with(
            lines,
            F.transform(bare, lambda b, i: F.struct(b.alias("bare"), ((b == "") & (before(i, 1, "x") == "") & (before(i, 2, "x") == "")).alias("blank"), ((b != "") & (before(i, 1, "") == b)).alias("twice"))),
            lambda line, j: F.struct(F.when(j["bare"] == "", F.lit("")).otherwise(line).alias("line"), j["blank"].alias("blank"), j["twice"].alias("twice")),
        )

    def made(x: Column, y: Column, free: Column, parts: Column) -> Column:
        kept = F.transform(F.filter(parts, lambda p: ~p["blank"] & ~p["twice"]), lambda p: p["line"])
        return F.struct(
            F.when(x == "", F.lit("")).otherwise(F.trim(F.array_join(kept, "\n"), F.lit("\n"))).alias("text"),
            F.contains(x, F.lit("\r")).alias("newline_normalized"),
            (F.length(free) != F.length(y)).alias("zero_width_removed"),
            F.when(x == "", 0).otherwise(F.size(F.filter(parts, lambda p: p["twice"]))).alias("duplicate_lines_removed"),
            F.when(x == "", 0).otherwise(F.size(F.filter(parts, lambda p: p["blank"]))).alias("blank_lines_collapsed"),
        )

    # The text, with line ends of one kind (y), and without zero-width characters (free), each made once.
    of_lines = lambda x, y, free, lines: let(let(F.transform(lines, trim_all), lambda bare: judged(lines, bare)), lambda parts: made(x, y, free, parts))
    of_free = lambda x, y, free: let(F.split(free, "\n"), lambda lines: of_lines(x, y, free, lines))
    one_end = lambda x: F.when(F.contains(x, F.lit("\r")), F.regexp_replace(x, r"\r\n?", "\n")).otherwise(x)
    return let(F.coalesce(x, F.lit("")), lambda x: let(one_end(x), lambda y: let(_zero_width_free(y), lambda free: of_free(x, y, free))))


def source_text(raw: Column, transcript: Column, ocr: Column) -> Column:
    parts = [F.when(F.coalesce(c, F.lit("")) != "", c) for c in (raw, transcript, ocr)]
    return F.concat_ws("\n", *parts)


def budgeted(raw: Column, transcript: Column, ocr: Column, max_transcript: int = 12_000, max_ocr: int = 6_000) -> Column:
    """The parts cut to their budgets and joined, before cleaning and the total cut."""
    return source_text(raw, F.substring(transcript, 1, max_transcript), F.substring(ocr, 1, max_ocr))


#: Where a sentence ends: after a line's end, after a run of full stops of the wide kind, "!" or "?", or after "." unless a digit follows.
#: The first part is all that most places of a text are tried against.
SENTENCE_END = r"(?<=[\n.!?。！？])(?:(?<=\n)|(?<=\.)(?!\p{Nd})|(?<=[。！？!?])(?![。！？!?]))"


def split_sentences(x: Column) -> Column:
    """All sentences with everything that stands between them: joined they give the text back."""
    return F.filter(F.split(F.coalesce(x, F.lit("")), SENTENCE_END), lambda s: s != "")


def without_blanks(parts: Column) -> Column:
    return F.filter(F.transform(parts, trim_all), lambda s: s != "")


def sentences(x: Column) -> Column:
    """Sentences without blanks around them; empty ones go."""
    return without_blanks(split_sentences(x))
