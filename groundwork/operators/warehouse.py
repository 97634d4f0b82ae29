"""The seven tables: schemas, reads, and new versions of tables for each kind of write."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


SCHEMAS = {
    "contents": "id string, source string, source_id string, source_url string, title string, author string, author_id string, description string, media_type string, raw_text string, transcript string, ocr_text string, content_hash string, content_hash_version int, needs_manual_review boolean, current_analysis_id string, status string, created_at timestamp, processed_at timestamp, error_type string, error_message string",
    "analyses": "id string, content_id string, analysis_type string, summary string, structured_json string, model string, prompt_version string, chunk_count int, created_at timestamp",
    "entities": "id string, canonical_name string, entity_type string, description string",
    "entity_aliases": "id string, entity_id string, alias string",
    "content_entities": "content_id string, entity_id string, confidence double",
    "topics": "id string, name string",
    "content_topics": "content_id string, topic_id string, confidence double",
}
UNIQUE = {"contents": ["source", "source_id"], "entities": ["canonical_name"], "entity_aliases": ["alias"], "content_entities": ["content_id", "entity_id"], "topics": ["name"], "content_topics": ["content_id", "topic_id"]}
PAYLOAD = ("source_url", "title", "author", "author_id", "description", "media_type", "raw_text", "transcript", "ocr_text", "content_hash", "content_hash_version", "needs_manual_review")

#: The folder of the manifests.
MANIFESTS = "_manifests"


def stable_id(kind: str, *parts: Column) -> Column:
    """A deterministic id of 32 hex digits from a natural key."""
    return F.substring(F.sha2(F.concat_ws("\x1f", F.lit(kind), *parts).cast("binary"), 256), 1, 32)


def no_rows(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows, which the optimizer knows: joins with it are planned away and no task is started for it."""
    return spark.createDataFrame([], schema).limit(0)


class Conflict(RuntimeError):
    """Another writer has replaced a table that this commit was made from."""


class Warehouse:
    """Tables as folders below a root that Spark can read, named by numbered manifests.

    A commit writes new folders for all tables that it changes and then names them in one manifest, which is put under the next
    number only if no file has it. So a commit shows as a whole or not at all, whatever is lost on the way, and of two writers
    of one number one goes on from what the other has put there: additions are checked again and stay, a replaced table that
    has changed since it was read is a Conflict. Folders are never written twice; what no manifest names is never read.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _at(self, path: str):
        return self._hadoop.Path(f"{self.root}/{path}")

    def _files(self):
        return self._hadoop.Path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        fs, folder = self._files(), self._at(MANIFESTS)
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _named(self, version: int) -> dict[str, list[str]]:
        """The folders of each table."""
        if version == 0:
            return {}
        stream = self._files().open(self._at(f"{MANIFESTS}/{version}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _name(self, version: int, tables: dict[str, list[str]]) -> bool:
        """Puts a manifest in place; False if that number is taken."""
        fs, draft = self._files(), self._at(f"{MANIFESTS}/.{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(json.dumps(tables).encode())
        out.close()
        context = self._hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        option = getattr(self._hadoop, "Options$Rename")
        never_over = self.spark.sparkContext._gateway.new_array(option, 1)
        never_over[0] = option.NONE
        try:
            context.rename(draft, self._at(f"{MANIFESTS}/{version}"), never_over)
        except Exception as error:
            if not fs.exists(self._at(f"{MANIFESTS}/{version}")):
                raise error
            fs.delete(draft, False)
            return False
        return True

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as the last commit, or the one of that number, left it; empty if nothing was written."""
        folders = self._named(self.version() if version is None else version).get(table)
        if not folders:
            return no_rows(self.spark, SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(*(f"{self.root}/{table}/{name}" for name in folders))

    def write(self, table: str, rows: DataFrame) -> None:
        """Replaces the table; breaks if a unique key has two rows, before anything becomes visible."""
        self.commit(replaced={table: rows})

    def append(self, table: str, rows: DataFrame) -> None:
        """Adds rows without writing the others again; breaks if a unique key would have two rows, before anything becomes visible."""
        self.commit(added={table: rows})

    def commit(self, replaced: dict[str, DataFrame] | None = None, added: dict[str, DataFrame] | None = None, base: int | None = None) -> int:
        """Replaces some tables and adds to others, all or nothing; returns the commit's number. base: the version that the
        replacements were made from, the last one if it isn't told."""
        replaced, added = replaced or {}, added or {}
        base = self.version() if base is None else base
        folders = {t: self._written(t, rows) for t, rows in (*replaced.items(), *added.items())}
        while True:
            last = self.version()
            named = self._named(last)
            if last != base and any(named.get(t) != self._named(base).get(t) for t in replaced):
                raise Conflict(f"{', '.join(replaced)} changed between versions {base} and {last}")
            for t in added:
                if t in UNIQUE and not self._keys(t, folders[t]).join(self.read(t, last), UNIQUE[t], "left_semi").isEmpty():
                    raise ValueError(f"{t}: {', '.join(UNIQUE[t])} must be unique")
            if self._name(last + 1, {**named, **{t: [folders[t]] for t in replaced}, **{t: [*named.get(t, []), folders[t]] for t in added}}):
                return last + 1

    def _written(self, table: str, rows: DataFrame) -> str:
        """A new folder with the rows; breaks if a unique key has two of them."""
        schema, name = T._parse_datatype_string(SCHEMAS[table]), uuid.uuid4().hex
        rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields)).write.parquet(f"{self.root}/{table}/{name}")
        if table in UNIQUE and not self._keys(table, name).groupBy(*UNIQUE[table]).count().filter("count > 1").isEmpty():
            raise ValueError(f"{table}: {', '.join(UNIQUE[table])} must be unique")
        return name

    def _keys(self, table: str, folder: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.root}/{table}/{folder}").select(*UNIQUE[table])

    def save_analyses(self, new: DataFrame) -> int:
        """Adds analyses and moves their contents' pointers in one commit; breaks if a content is missing, and adds nothing twice."""
        base = self.version()
        moved, fresh = _pointed(self.read("contents", base), self.read("analyses", base), new)
        return self.commit(replaced={"contents": moved}, added={"analyses": fresh}, base=base)


def insert_new(contents: DataFrame, rows: DataFrame) -> DataFrame:
    """contents with the rows whose (source, source_id) it lacks."""
    return contents.unionByName(rows.join(contents.select("source", "source_id"), ["source", "source_id"], "left_anti"), allowMissingColumns=True)


def refresh_payload(contents: DataFrame, updates: DataFrame) -> DataFrame:
    """The payload columns of matching ids are replaced, by nulls too; id, source_id, status, pointer and times stay."""
    new = updates.select(F.col("id").alias("__id"), *(F.col(c).alias(f"__{c}") for c in PAYLOAD))
    both = contents.join(new, contents["id"] == new["__id"], "left")
    hit = F.col("__id").isNotNull()
    return both.withColumns({c: F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)) for c in PAYLOAD}).select(*contents.columns)


def set_status(contents: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """changes: (id, status, error_type, error_message). Open states clear errors and processed_at, closed ones set them."""
    new = changes.select(F.col("id").alias("__id"), F.col("status").alias("__status"), F.col("error_type").alias("__type"), F.col("error_message").alias("__message"))
    both = contents.join(new, contents["id"] == new["__id"], "left")
    hit, closed = F.col("__id").isNotNull(), F.col("__status").isin("completed", "failed")
    return both.withColumns(
        {
            "status": F.when(hit, F.col("__status")).otherwise(F.col("status")),
            "error_type": F.when(hit, F.when(F.col("__status") == "failed", F.col("__type"))).otherwise(F.col("error_type")),
            "error_message": F.when(hit, F.when(F.col("__status") == "failed", F.col("__message"))).otherwise(F.col("error_message")),
            "processed_at": F.when(hit, F.when(closed, as_of)).otherwise(F.col("processed_at")),
        }
    ).select(*contents.columns)


def reset_to_pending(contents: DataFrame, ids: DataFrame) -> DataFrame:
    nothing = F.lit(None).cast("string")
    return set_status(contents, ids.select("id", F.lit("pending").alias("status"), nothing.alias("error_type"), nothing.alias("error_message")), F.lit(None).cast("timestamp"))


def append_analyses(contents: DataFrame, analyses: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contents, analyses): history grows, and each content points to its newest analysis. Breaks if a content is missing.

    A run that is repeated brings the ids it brought before; those are not added again.
    """
    moved, fresh = _pointed(contents, analyses, new)
    return moved, analyses.unionByName(fresh.select(*analyses.columns))


def _pointed(contents: DataFrame, analyses: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contents with their pointers moved, the analyses that are not stored yet)."""
    if not new.join(contents.select(F.col("id").alias("content_id")), "content_id", "left_anti").isEmpty():
        raise ValueError("an analysis has no content")
    fresh = new.join(analyses.select("id"), "id", "left_anti")
    top = new.groupBy("content_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("__to"))
    moved = contents.join(top, contents["id"] == top["content_id"], "left").withColumn("current_analysis_id", F.coalesce("__to", "current_analysis_id")).select(*contents.columns)
    return moved, fresh


def upsert_links(links: DataFrame, new: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last confidence of a key wins, a null too; stored rows come before new ones."""
    both = links.withColumn("__seq", F.lit(-1).cast("long")).unionByName(new.withColumn("__seq", F.col(seq).cast("long")).drop(seq))
    last = both.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("__seq"))))
    return last.filter("__n = 1").drop("__n", "__seq")


def current_analyses(contents: DataFrame, analyses: DataFrame) -> DataFrame:
    """Each content with its current analysis; the pointer alone decides."""
    named = analyses.select(*(F.col(c).alias(f"analysis_{c}") for c in analyses.columns))
    return contents.join(named, contents["current_analysis_id"] == named["analysis_id"], "left")


def listing(contents: DataFrame, analyses: DataFrame, status: str | None = None, limit: int = 50, offset: int = 0, most: int = 200) -> DataFrame:
    """A page of contents, newest first, with the number of analyses of each."""
    page = contents.filter(F.col("status") == status) if status else contents
    page = page.orderBy(F.desc("created_at"), "id").offset(max(0, offset)).limit(min(most, max(0, limit)))
    counts = analyses.join(page.select(F.col("id").alias("content_id")), "content_id", "left_semi").groupBy("content_id").agg(F.count("*").alias("n_analyses"))
    return page.join(counts, page["id"] == counts["content_id"], "left").drop("content_id").withColumn("n_analyses", F.coalesce("n_analyses", F.lit(0)))


def raw_again(contents: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw, missing): stored rows as raw content by id, a bad media type as text; ids that are not stored."""
    return as_raw(contents.join(ids.select("id"), "id", "left_semi")), ids.join(contents.select("id"), "id", "left_anti")


def as_raw(contents: DataFrame) -> DataFrame:
    """Stored rows as raw content, a bad media type as text."""
    good = F.col("media_type").isin("video", "image", "article", "audio", "text", "mixed")
    return contents.withColumn("media_type", F.when(good, F.col("media_type")).otherwise("text")).withColumn("source_url", F.coalesce("source_url", F.lit(""))).withColumn("media_path", F.lit(None).cast("string"))


def _is_stale(as_of: Column, seconds: int) -> Column:
    return (F.col("status") == "processing") & (F.col("created_at") <= as_of - F.make_dt_interval(secs=F.lit(max(0, seconds))))


def stale(contents: DataFrame, as_of: Column, seconds: int = 900) -> DataFrame:
    return contents.filter(_is_stale(as_of, seconds))


def reset_stale(contents: DataFrame, as_of: Column, seconds: int = 900) -> DataFrame:
    """contents with what is stale set back to pending, as reset_to_pending does it with ids; each row tells by itself, so none is moved."""
    hit = F.coalesce(_is_stale(as_of, seconds), F.lit(False)) & F.col("id").isNotNull()
    kept = {c: F.when(~hit, F.col(c)) for c in ("error_type", "error_message", "processed_at")}
    return contents.withColumns({**kept, "status": F.when(hit, "pending").otherwise(F.col("status"))}).select(*contents.columns)


def first_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: ordered distinct."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__n", n).filter("__n = 1").drop("__n")


