"""From prepared text to valid analyses: prompts, a user's model, repair, contract checks, retry rounds, synthesis."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundwork.functions.text import let
from groundwork.operators.lineage import released, stored
from groundwork.operators.repair import repair_outputs

# The contract's enumerations, and keys that reject a record.
ANALYSIS_TYPES = ("fact", "opinion", "tutorial", "news", "analysis", "prediction", "mixed")
CLAIM_TYPES = ("fact", "opinion", "inference", "prediction")
EVIDENCE_TYPES = ("source", "quote", "data", "reference", "none")
ENTITY_TYPES = ("person", "company", "place", "concept", "product", "organization", "other")
FORBIDDEN = ("needs_verification", "facts", "opinions", "inferences", "predictions")

EVIDENCE = "struct<type:string,description:string,source_url:string,timestamp:string>"
CLAIM = f"struct<text:string,type:string,author_position:string,time_horizon:string,based_on_claims:array<string>,evidence:array<{EVIDENCE}>,confidence:double,needs_verification:boolean>"
#: As the model writes it: the two fields that may be numeric strings or spelled booleans are read as text.
LOOSE_CLAIM = CLAIM.replace("confidence:double", "confidence:string").replace("needs_verification:boolean", "needs_verification:string")
LOOSE = f"struct<title:string,summary:string,analysis_type:string,claims:array<{LOOSE_CLAIM}>,questions:array<string>,topics:array<string>,entities:array<struct<name:string,type:string>>,keywords:array<string>,overall_confidence:string>"

PROMPT_VERSION = "analysis-1"
SCHEMA_TEXT = "title, summary, analysis_type, claims[text, type, author_position, time_horizon, based_on_claims, evidence[type, description, source_url, timestamp], confidence], questions, topics, entities[name, type], keywords, overall_confidence"


def analysis_prompts(chunks: DataFrame, id_col: str = "content_id") -> DataFrame:
    """(id, phase, prompt_id, part, prompt): one prompt for each chunk, with its place if there are several."""
    place = F.when(F.col("chunk_total") > 1, F.format_string("Part %d of %d of a long text: analyse this part only.\n", F.col("chunk_index") + 1, "chunk_total")).otherwise("")
    body = F.concat(F.lit("Analyse the text below and answer in JSON.\n"), place, F.lit(f"\nFields: {SCHEMA_TEXT}\n\n<<<CONTENT\n"), F.col("chunk"), F.lit("\nCONTENT>>>"))
    return chunks.select(F.col(id_col).alias("content_id"), F.lit("analysis").alias("phase"), F.concat_ws(":", F.col(id_col).cast("string"), "chunk_index").alias("prompt_id"), F.col("chunk_index").alias("part"), body.alias("prompt"))


def synthesis_prompts(analyses: DataFrame) -> DataFrame:
    """One prompt for each content with several parts, holding their analyses in order: (content_id, part, payload)."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("part", "payload"))), lambda x: x["payload"])
    joined = analyses.groupBy("content_id").agg(parts.alias("parts")).filter("size(parts) > 1")
    body = F.concat(F.format_string("Merge the %d analyses of one text below into one and answer in JSON.\n", F.size("parts")), F.lit(f"\nFields: {SCHEMA_TEXT}\n\n<<<CONTENT\n["), F.array_join("parts", ","), F.lit("]\nCONTENT>>>"))
    return joined.select("content_id", F.lit("synthesis").alias("phase"), F.concat(F.col("content_id").cast("string"), F.lit(":synthesis")).alias("prompt_id"), F.lit(0).alias("part"), body.alias("prompt"))


class RequestFailed(Exception):
    """What a model raises for a prompt that gets no answer. Any other exception is a bug and fails the job."""

    def __init__(self, error_type: str = "LLM_REQUEST_FAILED"):
        super().__init__(error_type)
        self.error_type = error_type


def infer(prompts: DataFrame, factory: Callable[[], Callable[[list[str]], list[str | None]]]) -> DataFrame:
    """prompts with raw_output and error_type. factory is called once in each task and gives a function from prompts to texts.

    A list of prompts whose request fails is asked again prompt by prompt, so that only those without an answer carry the
    error's type; an answer of None is a failed request too. A list of answers of another length is a bug.
    """
    schema = T.StructType([*prompts.schema.fields, T.StructField("raw_output", T.StringType()), T.StructField("error_type", T.StringType())])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()

        def ask(some: list[str]) -> list[tuple[str | None, str | None]]:
            try:
                answers = model(some)
            except RequestFailed as error:
                return [(None, error.error_type)] if len(some) == 1 else [x for prompt in some for x in ask([prompt])]
            if len(answers) != len(some):
                raise ValueError(f"{len(some)} prompts got {len(answers)} answers")
            return [(x, None if x is not None else "LLM_REQUEST_FAILED") for x in answers]

        for batch in batches:
            told = ask(batch["prompt"].tolist()) if len(batch) else []
            yield batch.assign(raw_output=[x for x, _ in told], error_type=[e for _, e in told])

    return prompts.mapInPandas(run, schema)


def scripted(prompts: DataFrame, script: DataFrame) -> DataFrame:
    """A model by table, for tests and replays: script (prompt_id, attempt, raw_output, error_type); prompts carry their attempt."""
    return prompts.join(script, ["prompt_id", "attempt"], "left").withColumn("error_type", F.when(F.col("raw_output").isNull(), F.coalesce("error_type", F.lit("LLM_REQUEST_FAILED"))))


def _bad_number(x: Column) -> Column:
    n = x.try_cast("double")
    return n.isNull() | (n < 0) | (n > 1)


def violations(payload: Column) -> Column:
    """Codes of all that breaks the contract in a JSON text, without any of its values."""
    # Read once for all codes.
    return let(F.struct(F.from_json(payload, LOOSE).alias("a"), F.json_object_keys(payload).alias("keys")), lambda read: _codes(read["a"], read["keys"]))


def _codes(a: Column, keys: Column) -> Column:
    claims = F.coalesce(a["claims"], F.array().cast(f"array<{LOOSE_CLAIM}>"))
    entities = F.coalesce(a["entities"], F.array().cast("array<struct<name:string,type:string>>"))
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    spelled = ("true", "false", "1", "0", "yes", "no", "on", "off", "t", "f", "y", "n")
    codes = [F.when(~F.array_contains(keys, c) | a[c].isNull(), F.lit(f"missing:{c}")) for c in ("title", "summary", "analysis_type", "claims", "overall_confidence")]
    codes += [F.when(F.array_contains(keys, c), F.lit(f"forbidden:{c}")) for c in FORBIDDEN]
    codes += [
        F.when(a["analysis_type"].isNotNull() & ~a["analysis_type"].isin(*ANALYSIS_TYPES), "enum:analysis_type"),
        F.when(a["overall_confidence"].isNotNull() & _bad_number(a["overall_confidence"]), "range:overall_confidence"),
        F.when(F.exists(claims, lambda c: blank(c["text"])), "blank:claims.text"),
        F.when(F.exists(claims, lambda c: ~F.coalesce(c["type"].isin(*CLAIM_TYPES), F.lit(False))), "enum:claims.type"),
        F.when(F.exists(claims, lambda c: _bad_number(c["confidence"])), "range:claims.confidence"),
        F.when(F.exists(claims, lambda c: c["needs_verification"].isNotNull() & ~F.lower(c["needs_verification"]).isin(*spelled)), "type:claims.needs_verification"),
        F.when(F.exists(claims, lambda c: F.exists(F.coalesce(c["evidence"], F.array().cast(f"array<{EVIDENCE}>")), lambda e: ~F.coalesce(e["type"].isin(*EVIDENCE_TYPES), F.lit(False)) | e["description"].isNull())), "enum:claims.evidence"),
        F.when(F.exists(entities, lambda e: blank(e["name"])), "blank:entities.name"),
        F.when(F.exists(entities, lambda e: ~F.coalesce(e["type"].isin(*ENTITY_TYPES), F.lit(False))), "enum:entities.type"),
    ]
    return F.when(keys.isNull(), F.array(F.lit("type:object"))).otherwise(F.array_compact(F.array(*codes)))


def validate(repaired: DataFrame, most: int = 5) -> DataFrame:
    """Repaired outputs with violations, valid, and a summary of at most `most` codes."""
    codes = F.when(F.col("payload").isNull(), F.array(F.lit("parse"))).otherwise(violations(F.col("payload")))
    out = repaired.select("*", F.explode(F.array(codes)).alias("violations"))  # made once, whatever is filtered by it or made of it
    more = F.when(F.size("violations") > most, F.format_string(" and %d more", F.size("violations") - most)).otherwise("")
    return out.withColumns({"valid": F.size("violations") == 0, "summary": F.concat(F.array_join(F.slice("violations", 1, most), "; "), more)})


def retry_rounds(prompts: DataFrame, model: Callable[[DataFrame], DataFrame], attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """(answers, log): the first valid answer of each prompt, and every attempt; a failed one has the step that failed: transport (no
    answer came), extraction (no JSON in it) or validation (it breaks the contract).

    A round asks only for prompts without a valid answer, with the last failure as a hint. The answers of a round are
    written before anything reads them: a stage that ran again would ask the model again. They go when they have been judged.
    """
    pending = prompts.withColumn("hint", F.lit(""))
    log = None
    for n in range(1, attempts + 1):
        asked = pending.withColumn("attempt", F.lit(n)).withColumn("prompt", F.when(F.col("hint") == "", F.col("prompt")).otherwise(F.concat("prompt", F.lit("\nThe last answer was refused: "), "hint")))
        heard = stored(model(asked))
        judged = validate(repair_outputs(heard.select("content_id", "phase", "prompt_id", "part", "attempt", "raw_output", "error_type")))
        error = F.when(F.col("error_type").isNotNull(), F.col("error_type")).when(~F.col("valid"), "LLM_INVALID_OUTPUT")
        step = F.when(F.col("error_type").isNotNull(), "transport").when(F.col("payload").isNull(), "extraction").when(~F.col("valid"), "validation")
        round_ = stored(judged.drop("raw_output").withColumns({"error_type": error, "valid": error.isNull(), "failed_step": step}))
        released(heard)
        log = round_ if log is None else log.unionByName(round_)
        failed = round_.filter("not valid").select("prompt_id", F.col("summary").alias("hint"))
        pending = prompts.join(failed, "prompt_id")
        if failed.isEmpty():
            break
    return log.filter("valid").select("content_id", "phase", "prompt_id", "part", "payload", "repairs"), log


def analyse(chunks: DataFrame, model: Callable[[DataFrame], DataFrame], attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """(results, log): results (content_id, chunk_count, payload, error_type); a content fails if any of its parts does."""
    prompts = analysis_prompts(chunks)
    answers, log = retry_rounds(prompts, model, attempts)
    parts = prompts.groupBy("content_id").agg(F.count("*").alias("chunk_count"))
    good = answers.groupBy("content_id").agg(F.count("*").alias("n_good"))
    # Counts alone are grouped: an answer is only moved to where its content is.
    whole = stored(parts.join(good, "content_id", "left").withColumn("complete", F.coalesce(F.col("n_good") == F.col("chunk_count"), F.lit(False))))
    split = whole.filter("complete and chunk_count > 1").select("content_id")
    payloads = answers.select("content_id", "payload").join(whole.filter("complete and chunk_count = 1").select("content_id"), "content_id", "left_semi")
    every = log
    if not split.isEmpty():
        several = answers.join(split, "content_id", "left_semi")
        merging = stored(synthesis_prompts(several))
        merged, merge_log = retry_rounds(merging, model, attempts)
        released(merging)
        payloads, every = payloads.unionByName(merged.select("content_id", "payload")), log.unionByName(merge_log)
    last = every.filter("error_type is not null").groupBy("content_id").agg(F.max_by("error_type", F.struct("phase", "attempt")).alias("last_error"))
    out = whole.join(payloads, "content_id", "left").join(last, "content_id", "left")
    return out.select("content_id", "chunk_count", "payload", F.when(F.col("payload").isNull(), F.coalesce("last_error", F.lit("LLM_INVALID_OUTPUT"))).alias("error_type")), every


def attempt_report(log: DataFrame) -> DataFrame:
    """(phase, attempt, n, n_failed, n_repaired): how the rounds went."""
    return log.groupBy("phase", "attempt").agg(F.count("*").alias("n"), F.count_if(~F.col("valid")).alias("n_failed"), F.count_if(F.col("repairs") != "").alias("n_repaired"))


def failure_report(log: DataFrame) -> DataFrame:
    """(phase, attempt, failed_step, error_type, n): the failed attempts by the step that failed."""
    return log.filter("not valid").groupBy("phase", "attempt", "failed_step", "error_type").agg(F.count("*").alias("n"))


def repairs_made(log: DataFrame) -> DataFrame:
    """(phase, repair, n): every repair of every attempt, also of those that failed all the same."""
    return log.filter("repairs <> ''").select("phase", F.explode(F.split("repairs", ",")).alias("repair")).groupBy("phase", "repair").agg(F.count("*").alias("n"))


def unnested(analyses: DataFrame, id_col: str = "content_id", payload_col: str = "payload") -> dict[str, DataFrame]:
    """claims, evidence, entities, topics, questions and keywords of valid payloads, each with its place."""
    a = analyses.select(F.col(id_col).alias("content_id"), F.from_json(payload_col, LOOSE).alias("a"))
    # The outer form, without its rows of nothing: for the plain one Spark would infer a filter, and make the payloads twice for it.
    each = lambda df, cols, xs, name: df.select(*cols, F.posexplode_outer(xs).alias("ord", name)).filter("ord is not null")
    claims = each(a, ["content_id"], "a.claims", "c").select("content_id", "ord", "c.text", "c.type", "c.author_position", "c.time_horizon", "c.based_on_claims", "c.evidence", F.expr("try_cast(c.confidence as double)").alias("confidence"))
    flat = lambda name: each(a, ["content_id"], f"a.{name}", "name")
    return {
        "claims": claims,
        "evidence": each(claims.withColumnRenamed("ord", "claim_ord"), ["content_id", "claim_ord"], "evidence", "e").select("content_id", "claim_ord", "ord", "e.*"),
        "entities": each(a, ["content_id"], "a.entities", "e").select("content_id", "ord", F.col("e.name").alias("name"), F.col("e.type").alias("entity_type")),
        "topics": flat("topics"),
        "questions": flat("questions").withColumnRenamed("name", "text"),
        "keywords": flat("keywords").withColumnRenamed("name", "text"),
    }
