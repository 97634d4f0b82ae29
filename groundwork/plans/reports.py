"""Queries over the reports of runs, failed attempts, refused answers, merged analyses and linked topics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.operators import analyses, jobs, repair, warehouse
from groundwork.operators import entities as ent
from groundwork.plans import derive
from groundwork.plans.derive import table
from groundwork.plans.runs import _NORM, _outputs, _quoted, _tables, as_of, marked
from groundwork.plans.text import _CLEAN

# ---- every code of the contract


def _object(fields: dict[str, Column]) -> Column:
    """A JSON object of the fields whose value isn't null."""
    shown = [F.concat(F.lit(f'"{k}": '), v) for k, v in fields.items()]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*shown)), ", "), F.lit("}"))


#: What breaks the contract, by place; the codes that it gives.
BREAKS = (
    "", *(f"missing:{c}" for c in ("title", "summary", "analysis_type", "claims", "overall_confidence")), *(f"forbidden:{c}" for c in analyses.FORBIDDEN),
    "enum:analysis_type", "range:overall_confidence", "blank:claims.text", "enum:claims.type", "range:claims.confidence", "type:claims.needs_verification", "enum:claims.evidence", "blank:entities.name", "enum:entities.type", "type:object",
)
#: Several at once: more than a summary shows.
MANY = ("missing:title", "forbidden:facts", "enum:analysis_type", "range:overall_confidence", "enum:claims.type", "range:claims.confidence", "blank:entities.name")


def k7_every_code(spark: SparkSession, d: str) -> DataFrame:
    """Answers made of whole texts, each of which breaks one rule of the contract, all of them in turn, or seven rules at once."""
    docs = table(spark, d, "documents")
    k = F.col("doc_id") % (len(BREAKS) + 1)
    has = lambda code: (k == BREAKS.index(code)) | ((k == len(BREAKS)) & F.lit(code in MANY))
    pick = lambda code, bad, good: F.when(has(code), bad).otherwise(good)
    text = _quoted(marked(F.col("text")))
    evidence = F.concat(F.lit('[{"type": '), pick("enum:claims.evidence", F.lit('"gossip"'), F.lit('"quote"')), F.lit(', "description": '), text, F.lit("}]"))
    claim = _object(
        {
            "text": pick("blank:claims.text", F.lit('" "'), text),
            "type": pick("enum:claims.type", F.lit('"rumour"'), F.lit('"opinion"')),
            "evidence": evidence,
            "confidence": pick("range:claims.confidence", F.lit('"high"'), F.lit('"0.5"')),
            "needs_verification": pick("type:claims.needs_verification", F.lit('"maybe"'), F.lit('"no"')),
        }
    )
    entity = _object({"name": pick("blank:entities.name", F.lit('""'), _quoted(F.col("source"))), "type": pick("enum:entities.type", F.lit('"planet"'), F.lit('"other"'))})
    listed = lambda x: F.concat(F.lit("["), x, F.lit("]"))
    fields = {"title": text, "summary": text, "analysis_type": pick("enum:analysis_type", F.lit('"guess"'), F.lit('"mixed"')), "claims": listed(claim), "overall_confidence": pick("range:overall_confidence", F.lit("1.5"), F.lit("1"))}
    fields = {c: F.when(~has(f"missing:{c}"), v) for c, v in fields.items()} | {"entities": listed(entity)} | {c: F.when(has(f"forbidden:{c}"), F.lit("[]")) for c in analyses.FORBIDDEN}
    answer = F.when(has("type:object"), listed(text)).otherwise(_object(fields))
    out = analyses.validate(repair.repair_outputs(docs.select("doc_id", answer.alias("raw_output"))))
    return out.select("doc_id", "valid", F.array_join("violations", ",").alias("codes"), "summary")


# ---- attempts by the step that failed


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Attempts over all documents: no JSON, a refused answer that is right the second time, requests that fail once or always."""
    out = _outputs(spark, d)
    said = out.select("content_id", "raw_output", F.regexp_replace("raw_output", '"guess"', '"fact"').alias("second"))

    def model(prompts: DataFrame) -> DataFrame:
        late, again = F.col("content_id").cast("long") % 16, F.col("attempt") > 1
        fails = (late == 15) | ((late == 7) & ~again)
        answer = F.when(~fails, F.when(again, F.col("second")).otherwise(F.col("raw_output")))
        return prompts.join(said, "content_id").select("content_id", "phase", "prompt_id", "part", "attempt", answer.alias("raw_output"), F.when(late == 15, "LLM_TIMEOUT").when(fails, "LLM_REQUEST_FAILED").alias("error_type"))

    return analyses.retry_rounds(out.select("content_id", "phase", "prompt_id", "part", F.lit("p").alias("prompt")), model)[1]


def a9_failed_steps(spark: SparkSession, d: str) -> DataFrame:
    return analyses.failure_report(_log(spark, d))


def a9_repairs(spark: SparkSession, d: str) -> DataFrame:
    return analyses.repairs_made(_log(spark, d))


# ---- synthesis of several parts

_BODY = r"(?s)<<<CONTENT\n(.*)\nCONTENT>>>"


def _reader(fails: Callable[[Column, Column], Column], lost: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    """A model that reads its prompt: the title of its answer is all of the prompt's content."""

    def model(prompts: DataFrame) -> DataFrame:
        body = F.regexp_extract("prompt", _BODY, 1)
        merged = F.col("phase") == "synthesis"
        title = F.when(merged, F.sha2(body.cast("binary"), 256)).otherwise(body)
        answer = F.concat(F.lit('{"title": '), _quoted(title), F.lit(', "summary": "s", "analysis_type": "fact", "claims": [], "overall_confidence": 1}'))
        said = F.when(lost(F.col("content_id")) & merged, None).when(fails(F.col("content_id"), F.col("part")) & ~merged, "no answer").otherwise(answer)
        return prompts.select("content_id", "phase", "prompt_id", "part", "attempt", said.alias("raw_output"), F.when(said.isNull(), "LLM_TIMEOUT").alias("error_type"))

    return model


def k9_synthesis(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as texts in parts, their turns: the analyses of the parts are merged by one more prompt that holds them in
    order; a part without an answer fails its content, and so does a synthesis whose request fails."""
    c = table(spark, d, "conversations")
    n = c.groupBy("conv_id").agg(F.count("*").cast("int").alias("chunk_total"))
    parts = c.join(n, "conv_id").select(F.col("conv_id").cast("string").alias("content_id"), F.col("turn").cast("int").alias("chunk_index"), "chunk_total", F.col("text").alias("chunk"))
    by = lambda cid: cid.cast("long") % 7
    results, _ = analyses.analyse(parts, _reader(lambda cid, part: (by(cid) == 3) & (part == 1), lambda cid: by(cid) == 5))
    return results.select("content_id", "chunk_count", "error_type", F.get_json_object("payload", "$.title").alias("title"))


# ---- topics


def j9_linked_topics(spark: SparkSession, d: str) -> DataFrame:
    """The topics that customers' analyses name, linked and listed by name: segments, nations' names in two spellings, and repeats."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    said = F.array(F.col("c_mktsegment"), F.concat(F.lit(" "), "n_name", F.lit("  trade")), F.concat("n_name", F.lit(" trade")), F.col("c_mktsegment"), F.lit(" "))
    topics = c.select(F.col("c_custkey").cast("string").alias("content_id"), F.posexplode(said).alias("ord", "name"))
    none = {t: spark.createDataFrame([], warehouse.SCHEMAS[t]) for t in ("entities", "entity_aliases", "topics", "content_entities", "content_topics")}
    names = topics.filter("false").select("content_id", "ord", "name", F.lit("other").alias("entity_type"))
    out = ent.link_contents(names, topics, none["entities"], none["entity_aliases"], none["topics"], none["content_entities"], none["content_topics"])
    return ent.linked_topics(out["content_topics"], out["topics"]).select("content_id", F.array_join("topics", "|").alias("topics"))


# ---- reports of a run


def _turns_run(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """A run over the turns of conversations as raw contents, by role; the model's answer follows what it reads."""
    c = table(spark, d, "conversations")
    raw = c.select((F.col("conv_id") * 100_000 + F.col("turn")).alias("seq"), F.col("role").alias("source"), F.concat_ws(":", "conv_id", "turn").alias("source_id"), F.lit("text").alias("media_type"), F.col("text").alias("raw_text"))

    def model(prompts: DataFrame) -> DataFrame:
        prompts = prompts.withColumn("body", F.regexp_extract("prompt", _BODY, 1)).withColumn("n", F.length(F.regexp_replace("body", r"\s", "")))
        body, n = F.col("body"), F.col("n")
        claim = F.concat(F.lit('{"text": '), _quoted(body), F.lit(', "type": "fact", "evidence": [{"type": "source", "description": "seen"}], "confidence": "0.5"}'))
        topics = F.array_join(F.transform(F.sequence(F.lit(0), n % 4), lambda i: F.concat(F.lit('"topic '), i.cast("string"), F.lit('"'))), ", ")
        good = F.concat(F.lit('{"title": "t", "summary": "s", "analysis_type": "fact", "claims": ['), F.array_join(F.array_repeat(claim, n % 3 + 1), ", "), F.lit('], "entities": [{"name": "thing '), (n % 5).cast("string"), F.lit('", "type": "other"}], "topics": ['), topics, F.lit('], "overall_confidence": 1}'))
        said = F.when(n % 8 == 5, None).when(n % 8 == 6, "no answer").otherwise(good)
        return prompts.select("content_id", "phase", "prompt_id", "part", "attempt", said.alias("raw_output"), F.when(n % 8 == 5, "LLM_TIMEOUT").alias("error_type"))

    return jobs.run(raw, _tables(spark), model, as_of())


def s10_run_reports(spark: SparkSession, d: str) -> DataFrame:
    """The JSON reports of a run over all turns of the conversations, read back."""
    r = jobs.processing_results(_turns_run(spark, d))
    at = lambda path: F.get_json_object("result", f"$.{path}")
    whole = ("chunk_count", "claim_count", "unverified_count", "entity_count", "topic_count")
    names = F.from_json(at("steps"), "array<struct<step:string,status:string>>")
    return r.select(
        "seq", *(at(c).alias(c) for c in ("outcome", "status", "deduplicated_by", "error_type", "error_message")), *(at(c).cast("long").alias(c) for c in whole),
        F.size(names).cast("long").alias("n_steps"), F.element_at(names, -1)["step"].alias("last_step"), at("note_path").isNotNull().alias("has_note"), at("analysis_id").isNotNull().alias("has_analysis"), at("duplicate_of").isNotNull().alias("has_original"),
    )


def w4_failed_steps(spark: SparkSession, d: str) -> DataFrame:
    """The last failed step of each turn of the conversations in the log that a run over them has written."""
    steps = _turns_run(spark, d)["steps"]
    return steps.groupBy("seq").agg(F.count("*").alias("n_steps")).join(jobs.failed_step(steps), "seq", "left")


def s10_recovery_reports(spark: SparkSession, d: str) -> DataFrame:
    """The JSON reports of contents that were set back, read back; pending ones got no outcome."""
    c = derive.contents(spark, d).filter("status <> 'processing'")
    recovered = c.select(F.col("id").alias("content_id"), F.col("status").alias("outcome"), F.when(F.col("status") == "failed", F.concat(F.lit("E"), (F.col("doc_id") % 3).cast("string"))).alias("error_type"))
    r = jobs.recovery_results(recovered, as_of(), 600)
    at = lambda path: F.get_json_object("result", f"$.{path}")
    return r.select("content_id", at("cutoff").alias("cutoff"), at("timeout_seconds").cast("int").alias("timeout_seconds"), at("resumed").alias("resumed"), at("failure").alias("failure"))


QUERIES = {f.__name__: f for f in (k7_every_code, a9_failed_steps, a9_repairs, k9_synthesis, j9_linked_topics, s10_run_reports, w4_failed_steps, s10_recovery_reports)}

_ASKED = "SELECT doc_id % 8 AS k, doc_id % 16 AS late, a FROM documents, (SELECT unnest([1, 2, 3]) AS a) WHERE a = 1 OR k = 6 OR late = 15 OR (a = 2 AND (k = 5 OR late = 7))"
_STEP = "CASE WHEN late = 15 OR (late = 7 AND a = 1) THEN 'transport' WHEN k = 6 THEN 'extraction' WHEN k = 5 AND a = 1 THEN 'validation' END"
_FIRST, _ALL = ", ".join(f"'{b}'" for b in BREAKS), ",".join(MANY)
#: Turns with what the run makes of them: twin of an earlier turn, nothing to read, a failing request, no answer.
_TURNS = f"""src AS (SELECT conv_id * 100000 + turn AS doc_id, role, text FROM conversations), {_CLEAN.format(text='text', src='src').strip()},
h AS (SELECT s.doc_id, length(regexp_replace(c.text, '\\s', '', 'g')) AS n, {_NORM.replace('text', 's.text')} = '' AS blank, min(s.doc_id) OVER (PARTITION BY role, {_NORM.replace('text', 's.text')}) <> s.doc_id AND NOT blank AS twin FROM src s JOIN cleaned c USING (doc_id)),
r AS (SELECT doc_id, n, twin, CASE WHEN twin THEN NULL WHEN n = 0 THEN 'EMPTY_SOURCE_TEXT' WHEN n % 8 = 5 THEN 'LLM_TIMEOUT' WHEN n % 8 = 6 THEN 'LLM_INVALID_OUTPUT' END AS e, NOT twin AND e IS NULL AS done FROM h),
t AS (SELECT *, CASE WHEN twin THEN 3 WHEN done THEN 13 WHEN n = 0 THEN 5 ELSE 6 END AS n_steps, CASE WHEN n_steps = 5 THEN 'prepare_text' WHEN n_steps = 6 THEN 'analyze' END AS failed_step FROM r)"""

ORACLE_SQL = {
    "k7_every_code": f"""WITH c AS (SELECT doc_id, CASE WHEN doc_id % {len(BREAKS) + 1} = {len(BREAKS)} THEN '{_ALL}' ELSE ([{_FIRST}])[doc_id % {len(BREAKS) + 1} + 1] END AS codes FROM documents)
SELECT doc_id, codes = '' AS valid, codes, CASE WHEN codes LIKE '%,%' THEN '{"; ".join(MANY[:5])} and {len(MANY) - 5} more' ELSE codes END AS summary FROM c""",
    "a9_failed_steps": f"SELECT 'analysis' AS phase, a AS attempt, {_STEP} AS failed_step, CASE WHEN late = 15 THEN 'LLM_TIMEOUT' WHEN late = 7 THEN 'LLM_REQUEST_FAILED' ELSE 'LLM_INVALID_OUTPUT' END AS error_type, count(*) AS n FROM ({_ASKED}) WHERE {_STEP} IS NOT NULL GROUP BY ALL",
    "a9_repairs": "SELECT 'analysis' AS phase, (['stripped_code_fence', 'extracted_json_object', 'inserted_missing_commas', 'removed_trailing_commas'])[doc_id % 8] AS repair, count(*) AS n FROM documents WHERE doc_id % 8 BETWEEN 1 AND 4 GROUP BY 2",
    "k9_synthesis": """WITH p AS (SELECT *, '{"title": ' || CAST(to_json(text) AS VARCHAR) || ', "summary": "s", "analysis_type": "fact", "claims": [], "overall_confidence": 1}' AS payload FROM conversations),
g AS (SELECT conv_id, count(*) AS n, bool_or(turn = 1) AS second, min(text) AS only_text, '[' || string_agg(payload, ',' ORDER BY turn) || ']' AS body FROM p GROUP BY conv_id),
e AS (SELECT *, CASE WHEN conv_id % 7 = 3 AND second THEN 'LLM_INVALID_OUTPUT' WHEN conv_id % 7 = 5 AND n > 1 THEN 'LLM_TIMEOUT' END AS error_type FROM g)
SELECT CAST(conv_id AS VARCHAR) AS content_id, n AS chunk_count, error_type, CASE WHEN error_type IS NULL THEN CASE WHEN n = 1 THEN only_text ELSE sha256(body) END END AS title FROM e""",
    "j9_linked_topics": "WITH t AS (SELECT c_custkey, c_mktsegment AS name FROM customer UNION SELECT c_custkey, n_name || ' trade' FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT CAST(c_custkey AS VARCHAR) AS content_id, string_agg(name, '|' ORDER BY name) AS topics FROM t GROUP BY 1",
    "s10_run_reports": f"""WITH {_TURNS} SELECT doc_id AS seq, CASE WHEN twin THEN 'duplicate' WHEN done THEN 'completed' ELSE 'failed' END AS outcome, CASE WHEN NOT twin THEN outcome END AS status, CASE WHEN twin THEN 'content_hash' END AS deduplicated_by, e AS error_type, e AS error_message,
CASE WHEN done THEN 1 ELSE 0 END AS chunk_count, CASE WHEN done THEN n % 3 + 1 ELSE 0 END AS claim_count, 0 AS unverified_count, CASE WHEN done THEN 1 ELSE 0 END AS entity_count, CASE WHEN done THEN n % 4 + 1 ELSE 0 END AS topic_count,
n_steps, CASE WHEN twin THEN 'deduplicate' WHEN done THEN 'complete' ELSE failed_step END AS last_step, NOT twin AS has_note, done AS has_analysis, twin AS has_original FROM t""",
    "w4_failed_steps": f"WITH {_TURNS} SELECT doc_id AS seq, n_steps, failed_step FROM t",
    "s10_recovery_reports": f"WITH {derive.CONTENTS_SQL} SELECT id AS content_id, '2024-01-31T23:50:00Z' AS cutoff, 600 AS timeout_seconds, CASE WHEN status = 'completed' THEN 'true' ELSE 'false' END AS resumed, CASE status WHEN 'failed' THEN 'E' || doc_id % 3 WHEN 'pending' THEN 'pending' END AS failure FROM contents WHERE status <> 'processing'",
}
