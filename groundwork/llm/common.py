"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.operators.lineage import BATCH_BYTES, checkpointed, shared_folder, small_batches, stored

__all__ = ["BATCH_BYTES", "BLOCK_BYTES", "checkpointed", "parts_of", "pick", "shared_folder", "small_batches", "stored", "table", "text_blocks", "tidy"]

#: Bytes of text that one step inside a task holds at a time.
BLOCK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, id_col: str, text_col: str, binary: bool = True) -> DataFrame:
    """The two columns that an operator reads, as (id, text); other columns can't clash. Meant for Python: see small_batches."""
    small_batches(df.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return df.select(F.col(f"`{id_col}`").alias("id"), (text.cast("binary") if binary else text).alias("text"))


def text_blocks(batches: Iterable[pa.RecordBatch], max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[pa.Array, list]]:
    """Cuts Arrow batches of (id, text, ...) into runs of rows with at most max_bytes of text, or one row."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        first = size = 0
        for i, n in enumerate(pc.binary_length(texts).to_pylist()):
            if size and size + n > max_bytes:
                yield ids.slice(first, i - first), texts.slice(first, i - first).to_pylist()
                first, size = i, 0
            size += n
        if first < batch.num_rows:
            yield ids.slice(first), texts.slice(first).to_pylist()


def parts_of(batches: Iterable[pa.RecordBatch], text_col: str, max_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches with a text column into runs of rows with at most max_bytes of text, or one row."""
    for batch in batches:
        first = size = 0
        for i, n in enumerate(pc.binary_length(batch.column(batch.schema.get_field_index(text_col))).to_pylist()):
            if size and size + (n or 0) > max_bytes:
                yield batch.slice(first, i - first)
                first, size = i, 0
            size += n or 0
        if first < batch.num_rows:
            yield batch.slice(first)


def tidy(run: Callable) -> Callable:
    """A function for mapInArrow that gives freed memory back to the system when its task ends: one Python worker serves many
    tasks and stages, and what one stage has left in the allocators would count against the next one's."""

    @functools.wraps(run)
    def inner(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return inner
