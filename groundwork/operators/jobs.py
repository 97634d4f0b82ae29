"""Whole runs over the tables: ingest to notes, reprocessing, recovery, and their reports."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions.names import cutoff, utc_text
from groundwork.operators import analyses, chunks, dedup, entities, grounding, notes, warehouse
from groundwork.operators.lineage import Stage, released, short_shuffles, small_methods, stage, stored
from groundwork.sources.note_files import standing_notes

# The steps of a run, in order.
STEPS = ("preflight", "normalize", "deduplicate", "persist_content", "prepare_text", "analyze", "persist_analysis", "extract_topics", "extract_entities", "normalize_aliases", "render_markdown", "write_obsidian", "complete")
#: Columns of raw content that hold texts.
WIDE = ("title", "description", "raw_text", "transcript", "ocr_text")


def enriched(raw: DataFrame, asset_text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw, attempts): asset_text (path, capability, status, text, error_type) fills transcript of video and audio and ocr_text of
    images where they are empty; one attempt row each: ok, skipped, unavailable or failed. No row is lost by a failure."""
    need = F.when(F.col("media_type").isin("video", "audio"), "transcribe").when(F.col("media_type") == "image", "ocr")
    has = F.when(need == "transcribe", F.col("transcript")).when(need == "ocr", F.col("ocr_text"))
    rows = raw.withColumn("__need", need).withColumn("__has", F.coalesce(F.trim(has), F.lit("")) != "")
    told = asset_text.select(F.col("path").alias("media_path"), F.col("capability").alias("__need"), F.col("status").alias("__status"), F.col("text").alias("__text"), F.col("error_type").alias("__error"))
    both = rows.join(told, ["media_path", "__need"], "left")
    use = ~F.col("__has") & (F.col("__status") == "ok")
    out = both.withColumn("transcript", F.when(use & (F.col("__need") == "transcribe"), F.col("__text")).otherwise(F.col("transcript"))).withColumn("ocr_text", F.when(use & (F.col("__need") == "ocr"), F.col("__text")).otherwise(F.col("ocr_text")))
    status = F.when(F.col("__has") | F.col("media_path").isNull(), "skipped").otherwise(F.coalesce("__status", F.lit("unavailable")))
    attempts = both.filter("__need is not null").select("source", "source_id", F.col("__need").alias("capability"), status.alias("status"), F.when(status == "failed", F.col("__error")).alias("error_type"))
    return out.select(*raw.columns), attempts


def run(raw: DataFrame, tables: dict[str, DataFrame], model: Callable[[DataFrame], DataFrame], as_of: Column, total: int = chunks.TOTAL, force: bool = False, existing_notes: DataFrame | None = None, vault: str | None = None, policy: str = "overwrite") -> dict[str, DataFrame]:
    """New versions of the seven tables, and outcomes, steps, notes with their paths, the paths alone, the attempt log and the stages,
    for a batch of raw content.

    raw needs seq, the arrival order. Duplicates stop after three steps unless force is set; a failure is a row with an
    error type, never a failed job. Each content's outcome is completed, failed or duplicate (of which content, if of one). existing_notes (path, source,
    source_id, foreign) are the notes that stand already; a note that finds no path of its own fails its content.

    vault is the folder that the notes are written below; the notes there stand already then, and the policy says what
    becomes of them. Without a vault nothing is written, and the log says that the step was skipped. What later stages read is
    written once, as Parquet below the shared folder; its rows, errors and seconds are the stages (ord, stage, rows, errors,
    seconds), and a step's elapsed time is that of the stage that took it for the whole batch. What no later stage and no result
    reads goes at once, and so do the shuffles of a stage. Notes are rendered in their stage; their markdown is kept where there
    is a vault, and made again for who reads it where there is none. A model with a function close is closed after its last answer.
    """
    with short_shuffles(raw.sparkSession):
        return _run(raw, tables, model, as_of, total, force, existing_notes, vault, policy)


def _run(raw: DataFrame, tables: dict[str, DataFrame], model: Callable[[DataFrame], DataFrame], as_of: Column, total: int, force: bool, existing_notes: DataFrame | None, vault: str | None, policy: str) -> dict[str, DataFrame]:
    spark = raw.sparkSession
    small_methods(spark)
    # Fingerprints are made once and kept without the texts: duplicates are found among them, and the log is told from them.
    wide = [c for c in WIDE if c in raw.columns]
    rows = stored(dedup.within_batch(stored(dedup.fingerprinted(raw).drop(*wide))))
    if force:
        rows = rows.withColumn("kept", F.lit(True))  # stored contents are run again even if their texts are equal
    judged = dedup.against_stored(rows.filter("kept"), tables["contents"])
    new_id = warehouse.stable_id("content", F.col("source"), F.col("source_id"))
    judged = judged.withColumn("content_id", F.coalesce("matched_id", new_id)).withColumn("skip", (F.col("outcome") == "duplicate") & F.lit(not force))
    stages: list[Stage] = []

    def kept(name: str, df: DataFrame, error: Column | None = None) -> DataFrame:
        out, told = stage(name, df, error)
        stages.append(told)
        return out

    judged = kept("deduplicate", judged.join(raw.select("seq", *wide), "seq"))  # read by every later stage
    work = judged.filter("not skip")
    field = lambda c, k="string": (F.col(c) if c in raw.columns else F.lit(None)).cast(k)
    texts = ("source_url", "title", "author", "author_id", "description", "raw_text", "transcript", "ocr_text")
    payload = work.select(F.col("content_id").alias("id"), "source", "source_id", *(field(c).alias(c) for c in texts), F.coalesce(field("media_type"), F.lit("text")).alias("media_type"), "content_hash", "content_hash_version", "needs_manual_review", F.lit(None).cast("string").alias("current_analysis_id"), F.lit("processing").alias("status"), as_of.alias("created_at"), F.lit(None).cast("timestamp").alias("processed_at"), F.lit(None).cast("string").alias("error_type"), F.lit(None).cast("string").alias("error_message"))
    contents = warehouse.refresh_payload(tables["contents"], payload)
    contents = contents.unionByName(payload.join(contents.select("id"), "id", "left_anti"))

    prepared = kept("prepare_text", chunks.prepare(payload.withColumnRenamed("id", "content_id"), total=total).select("content_id", "text"))
    table = kept("chunk", chunks.chunk_table(prepared, "content_id", chunks.chunk_chars(total)))
    results, log = analyses.analyse(table, model)
    empty = stored(prepared.select("content_id").join(table.select("content_id").distinct(), "content_id", "left_anti"))
    results = results.unionByName(empty.select("content_id", F.lit(0).cast("long").alias("chunk_count"), F.lit(None).cast("string").alias("payload"), F.lit("EMPTY_SOURCE_TEXT").alias("error_type")))
    results = kept("analyze", results, F.col("error_type"))
    released(table)
    getattr(model, "close", lambda: None)()
    good = results.filter("payload is not null")
    parts = analyses.unnested(good)
    parts |= {name: stored(parts[name]) for name in ("entities", "topics")}  # names alone, which many joins read
    names = entities.alias_index(tables["entities"], tables["entity_aliases"]).select(F.col("canonical_name").alias("canonical"), F.explode("aliases").alias("alias"))
    grounded = kept("ground", grounding.ground(parts["claims"], prepared.select("content_id", "text"), parts["entities"].select("content_id", "ord", "name"), names))
    sized = stored(prepared.select("content_id", F.length("text").alias("n_chars")))
    released(prepared)
    linked = entities.link_contents(parts["entities"], parts["topics"], tables["entities"], tables["entity_aliases"], tables["topics"], tables["content_entities"], tables["content_topics"])

    parsed = good.select("content_id", "chunk_count", "payload", F.from_json("payload", analyses.LOOSE).alias("a"))
    fresh = parsed.select(warehouse.stable_id("analysis", F.col("content_id"), as_of.cast("string"), F.col("payload")).alias("id"), "content_id", F.col("a.analysis_type").alias("analysis_type"), F.col("a.summary").alias("summary"), F.col("payload").alias("structured_json"), F.lit(None).cast("string").alias("model"), F.lit(analyses.PROMPT_VERSION).alias("prompt_version"), F.col("chunk_count").cast("int").alias("chunk_count"), as_of.alias("created_at"))
    contents, history = warehouse.append_analyses(contents, tables["analyses"], fresh)

    claim = F.struct("ord", "text", "type", "author_position", "time_horizon", "based_on_claims", "evidence", "confidence", "needs_verification")
    told = grounded.groupBy("content_id").agg(F.transform(F.array_sort(F.collect_list(claim)), lambda c: c.dropFields("ord")).alias("claims"))
    about = parsed.select("content_id", F.col("a.title").alias("analysis_title"), F.col("a.summary").alias("summary"), F.col("a.analysis_type").alias("analysis_type"), F.col("a.questions").alias("questions"), F.col("a.topics").alias("model_topics"), F.expr("try_cast(a.overall_confidence as double)").alias("overall_confidence"), F.lit(analyses.PROMPT_VERSION).alias("prompt_version"))
    original = payload.withColumnRenamed("id", "content_id").drop("status", "error_type", "error_message", "processed_at", "current_analysis_id")
    note_rows = original.join(about, "content_id").join(told, "content_id", "left").join(entities.linked_names(linked["content_entities"], linked["entities"], linked["entity_aliases"]), "content_id", "left").join(entities.linked_topics(linked["content_topics"], linked["topics"]), "content_id", "left")
    rendered = notes.render_notes(note_rows.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    lost = original.join(results.filter("payload is null").select("content_id", "error_type"), "content_id").withColumns({"error_message": F.col("error_type"), "created_at": F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")})
    if existing_notes is None and vault:
        existing_notes = notes.existing_index(standing_notes(raw.sparkSession, vault))
    if existing_notes is None:
        existing_notes = warehouse.no_rows(spark, "path string, source string, source_id string, foreign boolean")
    every_note = rendered.unionByName(notes.render_notes(lost, "failed"))
    both_kinds = every_note.withColumn("bytes", F.octet_length("markdown"))
    both_kinds = kept("render_markdown", both_kinds if vault else both_kinds.drop("markdown"))
    places = kept("place_notes", notes.assign_paths(both_kinds.drop("markdown"), existing_notes), F.col("path_error"))
    every_note = (both_kinds.drop("bytes") if vault else every_note).join(places.select("content_id", "path", "path_error"), "content_id")
    written = places.filter("false").select("content_id", F.lit("").alias("status"))
    if vault:
        began = time.monotonic()
        every_note = stored(every_note)  # read by the statuses and by the files
        released(both_kinds)
        written = notes.write_notes(every_note, vault, policy).select("content_id", "status")
        stages.append(Stage("write_obsidian", written.count(), 0, time.monotonic() - began))
    analyzed = results
    unplaced = places.filter("path_error is not null").select("content_id", "path_error")
    results = results.join(unplaced, "content_id", "left").withColumn("error_type", F.coalesce("error_type", "path_error")).drop("path_error")
    results = stored(results.drop("payload").withColumn("outcome", F.when(F.col("error_type").isNull(), "completed").otherwise("failed")))
    changes = results.select(F.col("content_id").alias("id"), F.col("outcome").alias("status"), "error_type", F.col("error_type").alias("error_message"))
    contents = warehouse.set_status(contents, changes, as_of)

    none = F.lit(None).cast("string")
    first = judged.select(F.col("seq").alias("duplicate_of"), F.col("content_id").alias("first_id"))
    dropped = rows.filter("not kept").join(first, "duplicate_of").select("seq", F.lit("duplicate").alias("outcome"), "deduplicated_by", none.alias("content_id"), none.alias("error_type"), F.col("first_id").alias("duplicate_of"))
    seen = judged.filter("skip").select("seq", F.lit("duplicate").alias("outcome"), F.col("matched_by").alias("deduplicated_by"), "content_id", none.alias("error_type"), F.col("content_id").alias("duplicate_of"))
    ended = work.select("seq", "content_id").join(results.select("content_id", "outcome", "error_type"), "content_id").select("seq", "outcome", none.alias("deduplicated_by"), "content_id", "error_type", none.alias("duplicate_of"))
    outcomes = dropped.unionByName(seen).unionByName(ended)

    # The log: what each stage's own rows say, and the time of the stage.
    took = {t.name: t.seconds for t in stages}
    of_stage = {"normalize": "deduplicate", "deduplicate": "deduplicate", "prepare_text": "prepare_text", "analyze": "analyze", "render_markdown": "render_markdown", "write_obsidian": "write_obsidian"}
    seqs = work.select("seq", "content_id")
    of = lambda df, step, detail=F.lit(None), error=F.lit(None), done=F.lit("ok"): df.select("seq", F.lit(STEPS.index(step)).alias("ord"), F.lit(step).alias("step"), F.when(error.isNotNull(), "failed").otherwise(done).alias("status"), detail.cast("string").alias("detail"), error.cast("string").alias("error_type"), F.lit(took.get(of_stage.get(step))).cast("double").alias("elapsed"))
    counted = lambda df: df.groupBy("content_id").agg(F.count("*").alias("n"))
    texts_done = seqs.join(sized, "content_id").join(empty.withColumn("none", F.lit(True)), "content_id", "left")
    asked = seqs.join(analyzed.filter("payload is not null or error_type <> 'EMPTY_SOURCE_TEXT'").select("content_id", "chunk_count", F.when(F.col("payload").isNull(), F.col("error_type")).alias("refused")), "content_id")
    answered = seqs.join(good.select("content_id", F.col("chunk_count")), "content_id")
    with_count = lambda df: answered.join(counted(df), "content_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    placed = answered.join(places.select("content_id", "path", "path_error", "bytes"), "content_id")
    parts_of_log = [
        of(rows, "preflight"), of(rows, "normalize", F.col("source_id")),
        of(rows.filter("not kept"), "deduplicate", F.col("deduplicated_by")), of(judged, "deduplicate", F.when(F.col("skip"), F.col("matched_by"))),
        of(seqs, "persist_content", F.col("content_id")), of(texts_done, "prepare_text", F.col("n_chars"), F.when(F.col("none"), "EMPTY_SOURCE_TEXT")),
        of(asked, "analyze", F.col("chunk_count"), F.col("refused")), of(answered, "persist_analysis", F.col("chunk_count")),
        of(with_count(parts["topics"]), "extract_topics", F.col("n")), of(with_count(parts["entities"]), "extract_entities", F.col("n")), of(with_count(linked["content_entities"]), "normalize_aliases", F.col("n")),
        of(placed, "render_markdown", F.col("bytes")), of(placed.join(written, "content_id", "left"), "write_obsidian", F.col("path"), F.col("path_error"), F.when(F.col("status") != "skipped", "ok").otherwise("skipped") if vault else F.lit("skipped")), of(placed.filter("path_error is null"), "complete"),
    ]
    steps = parts_of_log[0]
    for part in parts_of_log[1:]:
        steps = steps.unionByName(part)
    return {"contents": contents, "analyses": history, **linked, "outcomes": outcomes, "steps": steps, "notes": every_note, "paths": places.select("content_id", "path", "path_error"), "attempts": log, "grounded": grounded, "stages": spark.createDataFrame([(i, *t) for i, t in enumerate(stages)], "ord int, stage string, rows long, errors long, seconds double")}


def failed_step(steps: DataFrame) -> DataFrame:
    """(seq, failed_step): the last step of each run that failed."""
    return steps.filter("status = 'failed'").groupBy("seq").agg(F.max_by("step", "ord").alias("failed_step"))


def result_summary(contents: DataFrame, claims: DataFrame, content_entities: DataFrame, content_topics: DataFrame, history: DataFrame) -> DataFrame:
    """(content_id, n_claims, n_unverified, n_entities, n_topics, chunk_count) of each content."""
    c = claims.groupBy("content_id").agg(F.count("*").alias("n_claims"), F.count_if("needs_verification").alias("n_unverified"))
    e = content_entities.groupBy("content_id").agg(F.count("*").alias("n_entities"))
    t = content_topics.groupBy("content_id").agg(F.count("*").alias("n_topics"))
    current = contents.select(F.col("id").alias("content_id"), F.col("current_analysis_id").alias("__a"))
    n = history.select(F.col("id").alias("__a"), "chunk_count")
    out = current.join(n, "__a", "left").drop("__a")
    for part in (c, e, t):
        out = out.join(part, "content_id", "left")
    return out.na.fill(0, ["n_claims", "n_unverified", "n_entities", "n_topics", "chunk_count"])


def reprocess(ids: DataFrame, tables: dict[str, DataFrame], model, as_of: Column, total: int = chunks.TOTAL) -> tuple[dict[str, DataFrame], DataFrame]:
    """(run's result, missing): stored contents go through the run again; their history is kept."""
    raw, missing = warehouse.raw_again(tables["contents"], ids)
    return _run_again(raw, tables, model, as_of, total), missing


def _run_again(raw: DataFrame, tables: dict[str, DataFrame], model, as_of: Column, total: int) -> dict[str, DataFrame]:
    return run(raw.withColumn("seq", F.xxhash64("id")), tables, model, as_of, total, force=True)


def recover(tables: dict[str, DataFrame], model, as_of: Column, seconds: int = 900, total: int = chunks.TOTAL) -> tuple[dict[str, DataFrame], DataFrame]:
    """(run's result, recovered): work that has been in processing for too long is set back and run again.

    recovered (content_id, outcome, error_type) has a row for each content that was set back: completed, failed, or pending
    where the run gave no outcome. recovery_report() counts them.

    What is stale is written once with its texts, and alone is run again: no other content's text is moved.
    """
    old = stored(warehouse.stale(tables["contents"], as_of, seconds))
    reset = {**tables, "contents": warehouse.reset_stale(tables["contents"], as_of, seconds)}
    out = _run_again(warehouse.as_raw(warehouse.reset_stale(old, as_of, seconds).filter("id is not null")), reset, model, as_of, total)
    ended = out["outcomes"].filter("content_id is not null").select("content_id", "outcome", "error_type")
    recovered = old.select(F.col("id").alias("content_id")).join(ended, "content_id", "left").withColumn("outcome", F.coalesce("outcome", F.lit("pending")))
    return out, recovered


def recovery_report(outcomes: DataFrame) -> DataFrame:
    """(outcome, n, n_errors) of recovered contents, or of outcomes."""
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"), F.count("error_type").alias("n_errors"))


def run_report(steps: DataFrame) -> DataFrame:
    """(seq, report): each run's steps as one JSON text."""
    fields = [c for c in ("ord", "step", "status", "elapsed", "detail", "error_type") if c in steps.columns]
    ordered = F.array_sort(F.collect_list(F.struct(*fields)))
    return steps.groupBy("seq").agg(F.to_json(ordered).alias("report"))


def processing_results(out: dict[str, DataFrame]) -> DataFrame:
    """(seq, result): what became of each row of a run's batch, as one JSON text with its steps; out is what run() has returned.

    Only a completed content has an analysis, a note of its own and counts; the counts of others are 0, their ids null.
    """
    done = F.col("outcome") == "completed"
    own = lambda c: F.when(done, F.col(c))
    sums = result_summary(out["contents"], out["grounded"], out["content_entities"], out["content_topics"], out["analyses"])
    facts = out["contents"].select(F.col("id").alias("content_id"), "status", "current_analysis_id", "needs_manual_review", "error_message")
    paths = out["paths"].filter("path_error is null").select("content_id", "path")
    told = out["analyses"].select(F.col("id").alias("current_analysis_id"), "prompt_version", "model")
    fields = [F.struct("ord", "step", "status", "elapsed", "detail", "error_type")]
    steps = out["steps"].groupBy("seq").agg(F.array_sort(F.collect_list(*fields)).alias("steps"), F.sum("elapsed").alias("elapsed"))
    rows = out["outcomes"].join(facts, "content_id", "left").join(sums, "content_id", "left").join(paths, "content_id", "left").join(told, "current_analysis_id", "left").join(steps, "seq", "left")
    count = lambda c: F.coalesce(own(c), F.lit(0))
    result = F.struct(
        "outcome", "content_id", "status", own("current_analysis_id").alias("analysis_id"), F.when(F.col("outcome") != "duplicate", F.col("path")).alias("note_path"), "duplicate_of", "deduplicated_by",
        own("prompt_version").alias("prompt_version"), own("model").alias("model"), count("chunk_count").alias("chunk_count"), count("n_claims").alias("claim_count"), count("n_unverified").alias("unverified_count"),
        count("n_entities").alias("entity_count"), count("n_topics").alias("topic_count"), F.coalesce("needs_manual_review", F.lit(False)).alias("needs_manual_review"), "error_type",
        F.when(F.col("outcome") == "failed", F.col("error_message")).alias("error_message"), "elapsed", F.transform("steps", lambda s: s.dropFields("ord")).alias("steps"),
    )
    return rows.select("seq", F.to_json(result, {"ignoreNullFields": "false"}).alias("result"))


def recovery_results(recovered: DataFrame, as_of: Column, seconds: int = 900) -> DataFrame:
    """(content_id, result): what became of each content that recover() has set back, as one JSON text with the cutoff; a list of
    all of them in one text would grow with the table, so recovery_report() counts them instead."""
    resumed = F.col("outcome") == "completed"
    result = F.struct(utc_text(cutoff(as_of, seconds)).alias("cutoff"), F.lit(seconds).alias("timeout_seconds"), "content_id", F.lit(True).alias("reset"), resumed.alias("resumed"), F.when(~resumed, F.coalesce("error_type", "outcome")).alias("failure"))
    return recovered.select("content_id", F.to_json(result, {"ignoreNullFields": "false"}).alias("result"))
