"""Cutting a plan's lineage in a folder that all executors share."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Without that setting only a local session gets one, of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="groundwork-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


#: Bytes of a batch that Spark hands to Python: it lies in the JVM, in the pipe and in the worker at once.
BATCH_BYTES = 6 << 20
_UNSET = f"{64 << 20}b"  # Spark's default


def small_batches(spark: SparkSession) -> None:
    """Batches for Python are cut by their bytes as well as their rows: at BATCH_BYTES, or where the session has said."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == _UNSET:
        spark.conf.set(name, str(BATCH_BYTES))


#: Bytes of bytecode above which HotSpot never compiles a method, however often it runs.
METHOD_BYTES = 8000
_LARGEST = "65535"  # Spark's default


def small_methods(spark: SparkSession) -> None:
    """Generated code whose methods HotSpot would only interpret is left for code that Spark cuts into small ones, or as the session has said."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(name) == _LARGEST:
        spark.conf.set(name, str(METHOD_BYTES))


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes df to the session's checkpoint folder and reads it from there."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is executed meanwhile go when their job has ended, unless the session has said: else they stay until the
    driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    if name in spark.conf.getAll:
        yield
        return
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name)


def stored(df: DataFrame) -> DataFrame:
    """Writes df as Parquet below the shared folder and reads it from there; the table goes with released(), or when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def released(*tables: DataFrame) -> None:
    """Removes the files of stored tables; nothing that reads them may be executed afterwards."""
    for table in tables:
        place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


class Stage(NamedTuple):
    """What a written stage was: counted while it was written, without a pass of its own."""

    name: str
    rows: int
    errors: int
    seconds: float


def stage(name: str, df: DataFrame, error: Column | None = None) -> tuple[DataFrame, Stage]:
    """(df as a stored table, its stage): error is null in rows without one."""
    seen, began = Observation(), time.monotonic()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(F.lit(None) if error is None else error).alias("errors"))
    out = stored(counted)
    told = seen.get
    return out, Stage(name, told.get("rows", 0), told.get("errors", 0), time.monotonic() - began)
