"""Whole notes, compared text by text: claims of all types from the lines of whole documents, front matter, lists, fences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.operators import notes
from groundwork.operators.analyses import PROMPT_VERSION
from groundwork.plans import derive
from groundwork.plans.derive import table

_EVIDENCE = "array<struct<type:string,description:string,source_url:string,timestamp:string>>"


def k12_bodies(spark: SparkSession, d: str) -> DataFrame:
    """The note of each document: its non-blank lines are the claims, of all four types; topics are linked for even ids and the
    model's own for odd ones; the original has runs of back-ticks."""
    docs = table(spark, d, "documents")
    proof = lambda k, kind, url: F.struct(F.lit(kind).alias("type"), F.concat(F.lit("at  "), k.cast("string")).alias("description"), F.lit(url).cast("string").alias("source_url"), F.lit(None).cast("string").alias("timestamp"))
    evidence = lambda k: F.when(k % 3 == 0, F.array(proof(k, "quote", None), proof(k, "none", None), proof(k, "data", "http://x.test/"))).when(k % 3 == 1, F.array(proof(k, "none", None))).otherwise(F.array().cast(_EVIDENCE))
    claim = lambda said, k: F.struct(
        said.alias("text"), F.element_at(F.array(*(F.lit(t) for t in ("fact", "opinion", "inference", "prediction"))), k % 4 + 1).alias("type"),
        F.when(k % 5 == 1, F.col("lang")).alias("author_position"), F.when(k % 5 == 2, F.lit(" by\n2030 ")).alias("time_horizon"), F.when(k % 5 == 3, F.array(said, F.lit(" "), F.lit("b"))).alias("based_on_claims"),
        evidence(k).alias("evidence"), ((k * 37 % 101) / 100.0).alias("confidence"), (k % 3 != 0).alias("needs_verification"),
    )
    # A document's lines are in its row, so its claims are made there, in their order.
    claims = F.filter(F.transform(F.split("text", "\n"), claim), lambda c: F.trim(c["text"]) != "").alias("claims")
    even = F.col("doc_id") % 2 == 0
    rows = docs.select(
        F.col("doc_id").cast("string").alias("content_id"), F.col("lang").alias("source"), F.col("doc_id").cast("string").alias("source_id"), F.concat(F.lit("http://x.test/"), "doc_id").alias("source_url"),
        F.when(even, F.col("text")).alias("title"), F.when(F.col("doc_id") % 5 == 0, F.lit("it's: so")).alias("author"), F.lit("text").alias("media_type"), F.when(F.col("doc_id") % 3 > 0, F.lit("opinion")).alias("analysis_type"),
        F.col("text").alias("summary"), claims, F.when(F.col("doc_id") % 3 == 0, F.array(F.concat("source", F.lit(" ?")), F.lit(" "))).alias("questions"),
        F.when(even, F.array("source", "source")).alias("topics"), F.array("lang", F.lit(" "), "source", F.lit("yes")).alias("model_topics"),
        F.when(even, F.array(F.struct(F.col("lang").alias("canonical_name"), F.array(F.col("source"), F.lit(" "), F.lit("b  c")).alias("aliases")), F.struct(F.lit("Z").alias("canonical_name"), F.array().cast("array<string>").alias("aliases")))).alias("entities"),
        (F.col("doc_id") % 1000 / 1000.0).alias("overall_confidence"), F.lit("2024-01-01T00:00:00Z").alias("created_at"), F.lit(PROMPT_VERSION).alias("prompt_version"), (F.col("doc_id") % 7 == 0).alias("needs_manual_review"), F.lit(2).alias("content_hash_version"),
        F.replace("text", F.lit(" "), F.when(F.col("doc_id") % 4 == 1, F.lit(" ```` ")).otherwise(F.lit(" "))).alias("raw_text"), F.when(F.col("doc_id") % 4 == 0, F.col("lang")).alias("ocr_text"),
    )
    return notes.render_notes(rows).select("content_id", "markdown")


def k13_bodies(spark: SparkSession, d: str) -> DataFrame:
    """The notes of failed contents as whole texts."""
    rows = derive.contents(spark, d).filter("status = 'failed'").select(F.col("id").alias("content_id"), "source", "source_id", F.col("raw_text").alias("title"), "raw_text", F.lit("LLM_INVALID_OUTPUT").alias("error_type"), F.concat(F.lit("refused\nthrice: "), "raw_text").alias("error_message"), F.lit("2024-01-01").alias("created_at"))
    return notes.render_notes(rows, "failed").select("content_id", "markdown")


QUERIES = {f.__name__: f for f in (k12_bodies, k13_bodies)}

_BLANK = r"[\s\x0b\x{85}\p{Z}]+"
_NL = "chr(10)"


def _line(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{_BLANK}', ' ', 'g'), ' ')"


def _scalar(x: str) -> str:
    """Titles and names of the tables are printable: plain or in single quotes."""
    marks, types = (p.replace("'", "''") for p in (notes.NOT_PLAIN, notes.OTHER_TYPE))
    mark = "''''"
    return f"CASE WHEN {x} = '' THEN {mark} || {mark} WHEN regexp_matches({x}, '{marks}') OR regexp_matches({x}, '{types}') THEN {mark} || replace({x}, {mark}, {mark} || {mark}) || {mark} ELSE {x} END"


def _yaml(xs: str) -> str:
    return f"CASE WHEN len({xs}) = 0 THEN ' []' ELSE {_NL} || array_to_string(list_transform({xs}, lambda x: '- ' || {_scalar('x')}), {_NL}) END"


def _clean(xs: str) -> str:
    """The distinct lines of a list in their order."""
    lines = f"list_filter(list_transform({xs}, lambda x: {_line('x')}), lambda x: x <> '')"
    return f"list_filter({lines}, lambda x, i: list_position({lines}, x) = i)"


def _fence(x: str) -> str:
    marks = f"repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all({x}, '`+'), lambda r: length(r))), 0) + 1))"
    return f"CASE WHEN coalesce({x}, '') <> '' THEN {marks} || 'text' || {_NL} || regexp_replace({x}, '{_BLANK}$', '') || {_NL} || {marks} ELSE '{notes.NOTHING}' END"


def _note(src: str, failed: bool) -> str:
    """A SELECT of (content_id, markdown) over a table that has every column that a note reads; c_* are rendered claims."""
    plain = {k: _scalar(f"coalesce({k}, '')") for k in ("source", "source_id", "source_url", "author", "media_type", "analysis_type", "created_at", "prompt_version")}
    values = plain | {"title": _scalar("t"), "processed_at": "''''''", "model": "''''''", "confidence": "CAST(round(coalesce(overall_confidence, 0.0), 4) AS VARCHAR)", "needs_verification": "CASE WHEN flagged <> '' THEN 'true' ELSE 'false' END"}
    values |= {"needs_manual_review": "'true'" if failed else "CAST(needs_manual_review AS VARCHAR)", "content_hash_version": "CAST(content_hash_version AS VARCHAR)", "topics": "ts", "tags": "tags"}
    front = f" || {_NL} || ".join(f"'{k}:' || {_yaml(values[k])}" if k in ("topics", "tags") else f"'{k}: ' || ({values[k]})" for k in notes.KEYS)
    none = lambda x: f"coalesce(nullif({x}, ''), '{notes.NOTHING}')"
    bodies = [none(_line("summary")), *(none(c) for c in ("core", "c_fact", "c_opinion", "c_inference", "c_prediction", "flagged", "questions", "linked")), none(f"array_to_string(list_transform(ts, lambda x: '- [[' || x || ']]'), {_NL})"), *(_fence(c) for c in ("raw_text", "transcript", "ocr_text"))]
    parts = ["'# ' || (" + _scalar("t") + ")"]
    if failed:
        parts.append(f"'## 错误信息' || {_NL} || {_NL} || '- ' || error_type || {_NL} || '- ' || {_line('error_message')}")
    parts += [f"'## {name}' || {_NL} || {_NL} || ({body})" for name, body in zip(notes.SECTIONS, bodies)]
    text = f" || {_NL} || {_NL} || ".join(parts)
    return f"""named AS (SELECT *, coalesce(nullif({_line('title')}, ''), '{notes.UNTITLED}') AS t, {_clean('CASE WHEN len(coalesce(topics, [])) > 0 THEN topics ELSE coalesce(model_topics, []) END')} AS ts FROM {src}),
ready AS (SELECT *, {_clean("list_concat([analysis_type], ts)")} AS tags FROM named)
SELECT content_id, '---' || {_NL} || {front} || {_NL} || '---' || {_NL} || {_NL} || regexp_replace({text}, '\\n+$', '') || {_NL} AS markdown FROM ready"""


_CLAIM = f"""'- ' || said || CASE WHEN k % 5 = 1 THEN {_NL} || '  - 作者立场：' || {_line('lang')} WHEN k % 5 = 2 THEN {_NL} || '  - 时间范围：by 2030' WHEN k % 5 = 3 THEN {_NL} || '  - 基于：' || CASE WHEN said = '' THEN '' ELSE said || '；' END || 'b' ELSE '' END
|| CASE WHEN k % 3 = 0 THEN {_NL} || '  - 证据（quote）：at ' || k || {_NL} || '  - 证据（data）：at ' || k || ' — http://x.test/' ELSE '' END || {_NL} || '  - 置信度：' || printf('%.2f', c) || {_NL} || '  - 状态：' || CASE WHEN k % 3 = 0 THEN '已验证' ELSE '需验证' END"""
_TYPES = ("fact", "opinion", "inference", "prediction")

ORACLE_SQL = {
    "k12_bodies": f"""WITH ls AS (SELECT doc_id, lang, unnest(string_split(text, {_NL})) AS x, generate_subscripts(string_split(text, {_NL}), 1) - 1 AS k FROM documents),
cl AS (SELECT doc_id, lang, k, {_line('x')} AS said, (k * 37 % 101) / 100.0 AS c, ([{', '.join(f"'{t}'" for t in _TYPES)}])[k % 4 + 1] AS kind, row_number() OVER (PARTITION BY doc_id ORDER BY k * 37 % 101 DESC, k) AS place FROM ls WHERE trim(x, ' ') <> ''),
told AS (SELECT doc_id, string_agg('- ' || said || '（' || kind || '）', {_NL} ORDER BY place) FILTER (WHERE place <= 5) AS core, {', '.join(f"string_agg({_CLAIM}, {_NL} || {_NL} ORDER BY k) FILTER (WHERE kind = '{t}') AS c_{t}" for t in _TYPES)}, string_agg('- ' || said, {_NL} ORDER BY k) FILTER (WHERE k % 3 <> 0 AND said <> '') AS flagged FROM cl GROUP BY doc_id),
r AS (SELECT CAST(d.doc_id AS VARCHAR) AS content_id, lang AS source, CAST(d.doc_id AS VARCHAR) AS source_id, 'http://x.test/' || d.doc_id AS source_url, CASE WHEN d.doc_id % 2 = 0 THEN text END AS title, CASE WHEN d.doc_id % 5 = 0 THEN 'it''s: so' END AS author, 'text' AS media_type,
CASE WHEN d.doc_id % 3 > 0 THEN 'opinion' END AS analysis_type, text AS summary, CASE WHEN d.doc_id % 3 = 0 THEN '- ' || {_line("source || ' ?'")} END AS questions, CASE WHEN d.doc_id % 2 = 0 THEN [source, source] END AS topics, [lang, ' ', source, 'yes'] AS model_topics,
CASE WHEN d.doc_id % 2 = 0 THEN '- [[' || lang || ']]（' || {_line('source')} || '、b c）' || {_NL} || '- [[Z]]' END AS linked, d.doc_id % 1000 / 1000.0 AS overall_confidence, '2024-01-01T00:00:00Z' AS created_at, '{PROMPT_VERSION}' AS prompt_version, d.doc_id % 7 = 0 AS needs_manual_review, 2 AS content_hash_version,
CASE WHEN d.doc_id % 4 = 1 THEN replace(text, ' ', ' ```` ') ELSE text END AS raw_text, CAST(NULL AS VARCHAR) AS transcript, CASE WHEN d.doc_id % 4 = 0 THEN lang END AS ocr_text, core, c_fact, c_opinion, c_inference, c_prediction, coalesce(flagged, '') AS flagged FROM documents d LEFT JOIN told USING (doc_id)),
{_note('r', False)}""",
    "k13_bodies": f"""WITH {derive.CONTENTS_SQL}, r AS (SELECT id AS content_id, source, source_id, '' AS source_url, raw_text AS title, '' AS author, '' AS media_type, '' AS analysis_type, '' AS summary, '' AS questions, CAST([] AS VARCHAR[]) AS topics, CAST([] AS VARCHAR[]) AS model_topics, '' AS linked, 0.0 AS overall_confidence,
'2024-01-01' AS created_at, '' AS prompt_version, false AS needs_manual_review, 1 AS content_hash_version, raw_text, CAST(NULL AS VARCHAR) AS transcript, CAST(NULL AS VARCHAR) AS ocr_text, '' AS core, '' AS c_fact, '' AS c_opinion, '' AS c_inference, '' AS c_prediction, '' AS flagged, 'LLM_INVALID_OUTPUT' AS error_type, 'refused' || {_NL} || 'thrice: ' || raw_text AS error_message
FROM contents WHERE status = 'failed'), {_note('r', True)}""",
}
