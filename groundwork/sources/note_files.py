"""Notes as Markdown files below a folder: a Spark data source that writes them, and the reader of what stands there.

    spark.dataSource.register(NoteFiles)
    notes.select("path", "markdown").write.format("note_files").mode("append").option("path", root).option("policy", "overwrite").save()

Tasks write every note under a name of their own in a staging folder beside the notes; the commit, after all tasks have
succeeded, renames them to their paths one by one, as Spark's own committers do. A task that is lost or runs twice, and a job that fails,
leave no note half-written and none changed: the abort removes the staging folder. Files are UTF-8 with \\n line ends.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

POLICIES = ("overwrite", "keep_existing")


@dataclass
class Staged(WriterCommitMessage):
    """What a task has left: its folder, whose index names the notes, and how many there are."""

    folder: str
    n: int


class NoteWriter(DataSourceWriter):
    def __init__(self, root: str, policy: str):
        if policy not in POLICIES:
            raise ValueError(f"policy must be one of {', '.join(POLICIES)}")
        self.root, self.policy = root, policy
        self.staging = posixpath.join(root, f".staged-{uuid.uuid4().hex}")

    def _open(self, place: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(place) if ":/" in place else (fs.LocalFileSystem(), place)

    def write(self, iterator: Iterator[Row]) -> Staged:
        store, folder = self._open(posixpath.join(self.staging, str(TaskContext.get().taskAttemptId())))
        names = []
        for row in iterator:
            path = posixpath.normpath(row["path"])
            if posixpath.isabs(path) or path.startswith(("..", "~")):
                raise ValueError("a path leaves the folder")
            if self.policy == "keep_existing" and store.get_file_info(self._open(posixpath.join(self.root, path))[1]).type != fs.FileType.NotFound:
                continue
            if not names:
                store.create_dir(folder)
            with store.open_output_stream(f"{folder}/{len(names)}.md") as note:
                note.write(row["markdown"].encode())
            names.append(path)
        if names:
            with store.open_output_stream(f"{folder}/index") as index:
                index.write(json.dumps(names).encode())
        return Staged(folder, len(names))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, _ = self._open(self.root)
        made = set()
        for message in messages:
            if not isinstance(message, Staged) or not message.n:
                continue
            with store.open_input_stream(f"{message.folder}/index") as index:
                for n, path in enumerate(json.loads(index.read())):
                    target = self._open(posixpath.join(self.root, path))[1]
                    if (parent := posixpath.dirname(target)) not in made:
                        store.create_dir(parent)
                        made.add(parent)
                    store.move(f"{message.folder}/{n}.md", target)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, staging = self._open(self.staging)
        if store.get_file_info(staging).type != fs.FileType.NotFound:
            store.delete_dir(staging)


class NoteFiles(DataSource):
    """Options: path, the notes' folder on a file system that all executors share; policy, overwrite or keep_existing."""

    @classmethod
    def name(cls) -> str:
        return "note_files"

    def schema(self) -> str:
        return "path string, markdown string"

    def writer(self, schema: StructType, overwrite: bool) -> NoteWriter:
        if overwrite:
            raise ValueError("notes are written with mode append; the policy tells what becomes of those that stand")
        return NoteWriter(self.options["path"], self.options.get("policy", "overwrite"))


def standing_notes(spark: SparkSession, root: str) -> DataFrame:
    """(path, markdown) of the notes below root, paths relative to it; none if the folder isn't there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place):
        return spark.createDataFrame([], "path string, markdown string")
    base = store.makeQualified(place).toUri().getPath().rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    path = F.regexp_replace("path", r"^[a-z0-9]+:(//[^/]*)?", "")
    inside = F.substring(path, F.lit(len(base) + 1), F.length(path))
    return found.select(inside.alias("path"), F.col("content").cast("string").alias("markdown")).filter(~F.col("path").startswith("."))


def write_note_files(notes: DataFrame, root: str, policy: str = "overwrite") -> None:
    """Writes (path, markdown)."""
    notes.sparkSession.dataSource.register(NoteFiles)
    notes.select("path", "markdown").write.format("note_files").mode("append").option("path", root).option("policy", policy).save()
