"""Queries over the remaining operators: refreshes, enrichment, links, failure notes, reports, ordered lists, windows of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.functions import text
from groundwork.operators import entities as ent
from groundwork.operators import jobs, notes, numbers, warehouse
from groundwork.plans import derive
from groundwork.plans.derive import table
from groundwork.streaming import incremental


def p14_source_text(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations")
    return t.select("conv_id", "turn", text.source_text(F.when(F.col("turn") % 2 == 0, F.col("text")), F.col("role"), F.lit("")).alias("joined"))


def f5_key_numbers(spark: SparkSession, d: str) -> DataFrame:
    n = numbers.extract_numbers(table(spark, d, "documents"), ["doc_id"], "text")
    return n.groupBy("doc_id").agg(F.count_if(numbers.is_key(F.col("value"), F.col("kind"), F.col("scale"))).alias("n_key"))


def f3_has_evidence(spark: SparkSession, d: str) -> DataFrame:
    c = derive.claims(spark, d)
    return c.filter(F.exists("evidence", lambda e: e["type"] != "none")).groupBy("type").agg(F.count("*").alias("n"))


def d2_refresh_payload(spark: SparkSession, d: str) -> DataFrame:
    c = derive.contents(spark, d)
    full = c.withColumns({x: F.lit("old") for x in warehouse.PAYLOAD if x not in ("raw_text", "content_hash_version", "needs_manual_review")}).withColumns({"content_hash_version": F.lit(1), "needs_manual_review": F.lit(True)})
    new = full.filter("doc_id % 3 = 0").withColumns({"title": F.lit(None).cast("string"), "raw_text": F.upper("source"), "author": F.lit("new"), "needs_manual_review": F.lit(False)})
    return warehouse.refresh_payload(full, new).select("id", "title", "author", "status", "needs_manual_review", (F.length("raw_text") == 2).alias("short"))


def j15_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """Pages as media: videos get a transcript, images text, as far as the table of extracted texts has it."""
    p = table(spark, d, "pages")
    p = p.join(p.groupBy("url").agg(F.min("page_id").alias("page_id")), ["url", "page_id"], "left_semi")  # a url's first page
    kind = F.when(F.col("page_id") % 3 == 0, "video").when(F.col("page_id") % 3 == 1, "image").otherwise("article")
    raw = p.select(F.lit("web").alias("source"), F.col("page_id").cast("string").alias("source_id"), kind.alias("media_type"), F.col("url").alias("media_path"), F.when(F.col("page_id") % 4 == 0, F.lit("had")).alias("transcript"), F.lit(None).cast("string").alias("ocr_text"))
    told = p.filter("page_id % 5 <> 0").select(F.col("url").alias("path"), F.when(F.col("page_id") % 2 == 0, "transcribe").otherwise("ocr").alias("capability"), F.when(F.col("page_id") % 7 == 0, "failed").otherwise("ok").alias("status"), F.lit("said").alias("text"), F.lit("OCR_FAILED").alias("error_type"))
    out, attempts = jobs.enriched(raw, told)
    got = attempts.select("source_id", "capability", "status")
    return out.join(got, "source_id", "left").groupBy("media_type", "capability", "status", "transcript", "ocr_text").agg(F.count("*").alias("n"))


def k11_links(spark: SparkSession, d: str) -> DataFrame:
    """Customers' nations as entities and segments as topics of their analyses: the links per entity."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    names = c.select(F.col("c_custkey").cast("string").alias("content_id"), F.lit(0).alias("ord"), F.when(F.col("c_custkey") % 5 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("name"), F.lit("place").alias("entity_type"))
    topics = c.select(F.col("c_custkey").cast("string").alias("content_id"), F.lit(0).alias("ord"), F.col("c_mktsegment").alias("name"))
    empty = {t: spark.createDataFrame([], warehouse.SCHEMAS[t]) for t in ("topics", "content_entities", "content_topics")}
    out = ent.link_contents(names, topics, derive.entities(spark, d), derive.third_party_aliases(spark, d), empty["topics"], empty["content_entities"], empty["content_topics"])
    return out["content_entities"].groupBy("entity_id").agg(F.count("*").alias("n_contents"))


def d12_merge_by_name(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    ask = n.select(F.col("n_nationkey").cast("long").alias("seq"), F.concat(F.lit(" "), F.lower("n_name")).alias("source_name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("nowhere").alias("target_name"))
    return ent.merge_requests_by_name(ask, derive.entities(spark, d), derive.third_party_aliases(spark, d)).select("seq", "source_id", "target_id")


def w3_ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Each order's first line of each ship mode flag, in line order."""
    l = table(spark, d, "lineitem")
    return warehouse.first_rows(l, ["l_orderkey", "l_returnflag"], ["l_linenumber"]).select("l_orderkey", "l_returnflag", "l_linenumber")


def l2_status_list(spark: SparkSession, d: str) -> DataFrame:
    return derive.contents(spark, d).filter("status in ('pending', 'processing')").orderBy("created_at", "id").select("id", "status")


def l3_names(spark: SparkSession, d: str) -> DataFrame:
    e, a = derive.entities(spark, d), derive.third_party_aliases(spark, d)
    return e.join(a.select(F.col("entity_id").alias("__e"), "alias"), e["id"] == F.col("__e"), "left").select("canonical_name", "alias").orderBy("canonical_name", "alias")


def k13_failure_notes(spark: SparkSession, d: str) -> DataFrame:
    rows = derive.contents(spark, d).filter("status = 'failed'").select(F.col("id").alias("content_id"), "source", "source_id", "raw_text", F.lit("LLM_INVALID_OUTPUT").alias("error_type"), F.lit("refused\nthrice").alias("error_message"), F.col("created_at").cast("string").alias("created_at"))
    n = notes.render_notes(rows, "failed")
    return n.select("content_id", "kind", "file_name", F.contains("markdown", F.lit("needs_manual_review: true")).alias("asks_review"), F.contains("markdown", F.lit("- LLM_INVALID_OUTPUT\n- refused thrice")).alias("tells_error"))


def s8_note_status(spark: SparkSession, d: str) -> DataFrame:
    rows = derive.contents(spark, d).select(F.col("id").alias("path"), F.concat(F.lit("é"), "source").alias("markdown"))
    old = rows.filter("cast(path as bigint) % 3 = 0").select("path")
    return notes.write_status(rows, old, "keep_existing").select("path", "status", F.col("n_bytes").cast("long").alias("n_bytes"))


def a15_recovery_report(spark: SparkSession, d: str) -> DataFrame:
    o = derive.contents(spark, d).select(F.when(F.col("status") == "failed", "failed").otherwise("completed").alias("outcome"), F.when(F.col("status") == "failed", "X").alias("error_type"))
    return jobs.recovery_report(o)


def x4_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """The stream's counts over a table that is there as a whole: events of each type in each hour."""
    return incremental.counts(table(spark, d, "events"), ["event_type"], "ts")


def x2_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """The batch form of the stream's first-seen rows: the first event of each user."""
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("f")).select("user_id", F.col("f.ts").alias("ts"), F.col("f.event_id").alias("event_id"))


QUERIES = {f.__name__: f for f in (p14_source_text, f5_key_numbers, f3_has_evidence, d2_refresh_payload, j15_enrichment, k11_links, d12_merge_by_name, w3_ordered_distinct, l2_status_list, l3_names, k13_failure_notes, s8_note_status, a15_recovery_report, x4_event_counts, x2_first_seen)}

ORACLE_SQL = {
    "p14_source_text": "SELECT conv_id, turn, concat_ws(chr(10), CASE WHEN turn % 2 = 0 THEN nullif(text, '') END, nullif(role, '')) AS joined FROM conversations",
    "f3_has_evidence": f"WITH {derive.CLAIMS_SQL} SELECT 'fact' AS type, count(*) AS n FROM claims WHERE quality = 1",
    "d2_refresh_payload": f"WITH {derive.CONTENTS_SQL} SELECT id, CASE WHEN doc_id % 3 <> 0 THEN 'old' END AS title, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS author, status, doc_id % 3 <> 0 AS needs_manual_review, doc_id % 3 = 0 OR length(raw_text) = 2 AS short FROM contents",
    "j15_enrichment": """WITH p AS (SELECT DISTINCT ON (url) * FROM pages ORDER BY url, page_id), r AS (SELECT *, CASE page_id % 3 WHEN 0 THEN 'video' WHEN 1 THEN 'image' ELSE 'article' END AS media_type, CASE WHEN page_id % 4 = 0 THEN 'had' END AS had FROM p),
n AS (SELECT *, CASE media_type WHEN 'video' THEN 'transcribe' WHEN 'image' THEN 'ocr' END AS capability, CASE WHEN media_type = 'video' THEN had IS NOT NULL ELSE false END AS has, page_id % 5 <> 0 AND (CASE WHEN page_id % 2 = 0 THEN 'transcribe' ELSE 'ocr' END) = (CASE media_type WHEN 'video' THEN 'transcribe' WHEN 'image' THEN 'ocr' END) AS told FROM r),
s AS (SELECT *, CASE WHEN capability IS NULL THEN NULL WHEN has THEN 'skipped' WHEN told AND page_id % 7 = 0 THEN 'failed' WHEN told THEN 'ok' ELSE 'unavailable' END AS status FROM n)
SELECT media_type, capability, status, CASE WHEN capability = 'transcribe' AND status = 'ok' THEN 'said' ELSE had END AS transcript, CASE WHEN capability = 'ocr' AND status = 'ok' THEN 'said' END AS ocr_text, count(*) AS n FROM s GROUP BY 1, 2, 3, 4, 5""",
    "k11_links": "SELECT CAST(c_nationkey AS VARCHAR) AS entity_id, count(*) AS n_contents FROM customer GROUP BY 1",
    "d12_merge_by_name": "SELECT CAST(n_nationkey AS BIGINT) AS seq, CAST(n_nationkey AS VARCHAR) AS source_id, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS VARCHAR) END AS target_id FROM nation",
    "w3_ordered_distinct": "SELECT l_orderkey, l_returnflag, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1, 2",
    "l2_status_list": f"WITH {derive.CONTENTS_SQL} SELECT id, status FROM contents WHERE status IN ('pending', 'processing') ORDER BY created_at, id",
    "l3_names": f"WITH {derive.ALIASES_SQL} SELECT canonical_name, alias FROM entities LEFT JOIN aliases ON entity_id = id ORDER BY 1, 2",
    "k13_failure_notes": f"WITH {derive.CONTENTS_SQL} SELECT id AS content_id, 'failed' AS kind, left(id, 8) AS file_name, true AS asks_review, true AS tells_error FROM contents WHERE status = 'failed'",
    "s8_note_status": f"WITH {derive.CONTENTS_SQL} SELECT id AS path, CASE WHEN doc_id % 3 = 0 THEN 'skipped' ELSE 'created' END AS status, 2 + length(source) AS n_bytes FROM contents",
    "a15_recovery_report": f"WITH {derive.CONTENTS_SQL} SELECT CASE WHEN status = 'failed' THEN 'failed' ELSE 'completed' END AS outcome, count(*) AS n, count(*) FILTER (WHERE status = 'failed') AS n_errors FROM contents GROUP BY 1",
    "x4_event_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "x2_first_seen": "SELECT user_id, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id",
}
