"""Preparing text for a model: budget, cleaning, chunks of whole sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions.text import budgeted, clean_source_text, let, sentences

TOTAL = 24_000


def chunk_chars(total: int = TOTAL) -> int:
    """Room for text in a prompt: the total less what the instructions take."""
    return max(1, total - min(4000, total // 2))


def pieces(text: Column, max_chars: int) -> Column:
    """Sentences; those that are too long are cut by characters."""
    cut = lambda s: F.transform(F.sequence(F.lit(1), F.length(s), F.lit(max_chars)), lambda i: F.substring(s, i, F.lit(max_chars)))
    return let(sentences(text), lambda ss: F.when(F.exists(ss, lambda s: F.length(s) > max_chars), F.flatten(F.transform(ss, cut))).otherwise(ss))


def chunks(text: Column, max_chars: int, overlap: int = 1) -> Column:
    """array<string>: pieces packed greedily into chunks of at most max_chars; a chunk starts with the last `overlap` pieces of the one before, fewer if they leave no room.

    The fold goes over the pieces' lengths and gives each chunk's first piece and number of pieces, so no text is copied
    but into its chunk."""
    ints = F.array().cast("array<int>")
    start = F.struct(F.array().cast("array<struct<first:int,n:int>>").alias("done"), F.lit(0).alias("first"), F.lit(0).alias("at"), F.lit(0).alias("size"), ints.alias("last"))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def tail(last: Column, n: Column) -> Column:
        """The lengths of the pieces that the next chunk starts with: of the last ones, the most that leave room for n."""
        if not overlap:
            return ints
        if overlap == 1:
            return F.filter(last, lambda x: x + n <= max_chars)
        suffixes = F.transform(F.sequence(F.lit(1), F.size(last) + 1), lambda i: F.slice(last, i, F.greatest(F.size(last) - i + 1, F.lit(0))))
        return F.coalesce(F.get(F.filter(suffixes, lambda xs: total(xs) + n <= max_chars), F.lit(0)), ints)

    def lasts(xs: Column, n: Column) -> Column:
        if overlap <= 1:
            return F.array(n) if overlap else ints
        return let(F.concat(xs, F.array(n)), lambda ys: F.slice(ys, F.greatest(F.size(ys) - overlap + 1, F.lit(1)), overlap))

    def step(a: Column, n: Column) -> Column:
        state = lambda done, first, size, last: F.struct(done.alias("done"), first.alias("first"), (a["at"] + 1).alias("at"), size.alias("size"), last.alias("last"))
        ended = F.concat(a["done"], F.array(F.struct(a["first"].alias("first"), (a["at"] - a["first"]).alias("n"))))
        full = (a["at"] > a["first"]) & (a["size"] + n > max_chars)
        begun = let(tail(a["last"], n), lambda kept: state(ended, a["at"] - F.size(kept), total(kept) + n, lasts(kept, n)))
        return F.when(full, begun).otherwise(state(a["done"], a["first"], a["size"] + n, lasts(a["last"], n)))

    def packed(ps: Column) -> Column:
        bounds = F.aggregate(F.transform(ps, F.length), start, step, lambda a: F.when(a["at"] > a["first"], F.concat(a["done"], F.array(F.struct(a["first"].alias("first"), (a["at"] - a["first"]).alias("n"))))).otherwise(a["done"]))
        return F.transform(bounds, lambda b: F.array_join(F.slice(ps, b["first"] + 1, b["n"]), ""))

    return let(pieces(text, max_chars), packed)


def prepare(raw: DataFrame, max_transcript: int = 12_000, max_ocr: int = 6_000, total: int = TOTAL) -> DataFrame:
    """raw with text (joined, cleaned, cut), the original lengths, three truncation flags and the cleaning counts."""
    texts = [F.col(c) if c in raw.columns else F.lit(None).cast("string") for c in ("raw_text", "transcript", "ocr_text")]
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    out = raw.withColumn("__clean", clean_source_text(budgeted(*texts, max_transcript, max_ocr)))
    text = F.col("__clean.text")
    return out.withColumns(
        {
            "text": F.substring(text, 1, total),
            "raw_chars": size(texts[0]),
            "transcript_chars": size(texts[1]),
            "ocr_chars": size(texts[2]),
            "transcript_truncated": size(texts[1]) > max_transcript,
            "ocr_truncated": size(texts[2]) > max_ocr,
            "total_truncated": F.length(text) > total,
            "duplicate_lines_removed": F.col("__clean.duplicate_lines_removed"),
            "blank_lines_collapsed": F.col("__clean.blank_lines_collapsed"),
            "newline_normalized": F.col("__clean.newline_normalized"),
            "zero_width_removed": F.col("__clean.zero_width_removed"),
        }
    ).drop("__clean")


def chunk_table(prepared: DataFrame, id_col: str, max_chars: int | None = None, overlap: int = 1) -> DataFrame:
    """(id, chunk_index, chunk_total, chunk): the chunks of each prepared text; none for an empty one."""
    counted = let(chunks(F.col("text"), max_chars or chunk_chars(), overlap), lambda cs: F.transform(cs, lambda c: F.struct(c.alias("chunk"), F.size(cs).alias("chunk_total"))))
    # The array is used once, by the outer form of explode: a second use, or the filter on its size that the plain form
    # has inferred below it, would make all chunks once more.
    made = prepared.select(id_col, F.posexplode_outer(counted).alias("chunk_index", "__chunk")).filter("__chunk is not null")
    return made.select(id_col, "chunk_index", "__chunk.chunk", "__chunk.chunk_total")
