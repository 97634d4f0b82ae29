"""Text out of media files by a user's providers: one attempt row for each file, whatever happens."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class CapabilityError(Exception):
    """What a provider raises for a file that it can't read. Any other exception is a bug and fails the job."""

    def __init__(self, error_type: str = "CAPABILITY_FAILED"):
        super().__init__(error_type)
        self.error_type = error_type


class Provider(Protocol):
    name: str

    def is_available(self) -> bool:
        """Whether what it needs is there, in this task's process."""

    def text_of(self, content: bytes, path: str) -> str | None:
        """The text of one file; None if there is none to be found."""


class NoProvider:
    """The provider of a capability for which none is set: never available."""

    name = "none"

    def is_available(self) -> bool:
        return False

    def text_of(self, content: bytes, path: str) -> str | None:
        raise CapabilityError("CAPABILITY_UNAVAILABLE")


_ATTEMPT = {"capability": pa.string(), "provider": pa.string(), "status": pa.string(), "text": pa.string(), "error_type": pa.string(), "elapsed_ms": pa.float64()}
_KINDS = {pa.string(): T.StringType(), pa.float64(): T.DoubleType()}


def extracted_text(assets: DataFrame, factories: dict[str, Callable[[], Provider]]) -> DataFrame:
    """(path, capability, provider, status, text, error_type, elapsed_ms) of assets (path, capability, content), which
    spark.read.format("binaryFile") gives but for the capability.

    A task makes each provider once, when it meets the first file for it, and asks it once whether it is available. ok: there
    is text; skipped: no capability is asked for, no content, or no text in it; unavailable: no provider, or one that can't
    work; failed: the provider has raised a CapabilityError. jobs.enriched takes these rows.
    """
    rows = assets.select("path", "capability", "content")

    def attempt(provider: Provider | None, available: bool, content: bytes | None, path: str) -> tuple:
        if provider is None or content is None:
            return ("none" if provider is None else provider.name, "skipped", None, None, None)
        if not available:
            return provider.name, "unavailable", None, "CAPABILITY_UNAVAILABLE", None
        began = time.monotonic()
        took = lambda: 1000 * (time.monotonic() - began)
        try:
            text = provider.text_of(content, path)
        except CapabilityError as error:
            return provider.name, "failed", None, error.error_type, took()
        return (provider.name, "ok", text, None, took()) if text and text.strip() else (provider.name, "skipped", None, None, took())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, tuple[Provider, bool]] = {}
        for batch in batches:
            for i in range(batch.num_rows):  # one file at a time, as files are large
                path, capability, content = (batch.column(c)[i].as_py() for c in range(3))
                if capability is not None and capability not in made:
                    provider = factories.get(capability, NoProvider)()
                    made[capability] = provider, provider.is_available()
                told = attempt(*made.get(capability, (None, False)), content, path)
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), *(pa.array([x], k) for x, k in zip((capability, *told), _ATTEMPT.values()))], names=["path", *_ATTEMPT])

    return rows.mapInArrow(run, T.StructType([T.StructField("path", T.StringType()), *(T.StructField(n, _KINDS[k]) for n, k in _ATTEMPT.items())]))


def scripted_text(assets: DataFrame, script: DataFrame) -> DataFrame:
    """The same columns from a table (path, capability, status, text, error_type), for tests and replays; unavailable where it has no row."""
    found = assets.select("path", "capability").join(script, ["path", "capability"], "left").na.fill({"status": "unavailable"})
    return found.selectExpr("path", "capability", "'script' AS provider", "status", "text", "CASE WHEN status = 'unavailable' THEN 'CAPABILITY_UNAVAILABLE' ELSE error_type END AS error_type", "CAST(NULL AS DOUBLE) AS elapsed_ms")
