"""What a run leaves on the disk: what no result reads goes while it runs, and nothing that a result reads."""

import os
import time

from pyspark.sql import functions as F

from groundwork.operators import jobs, lineage
from groundwork.plans import runs

NAME = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _standing(spark):
    folder = lineage.shared_folder(spark).removeprefix("file://")
    return {f for f in os.listdir(folder) if f.startswith("stored-")}


def _shuffles(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_") and files.apply(i).getName().endswith(".data")}


def test_a_run_removes_what_no_result_reads(spark):
    rows = spark.range(24).select(F.col("id").alias("seq"), F.lit("s").alias("source"), F.col("id").cast("string").alias("source_id"), F.format_string("Text %d. It says so.", F.col("id") % 20).alias("raw_text"))
    good = '{"title": "t", "summary": "s", "analysis_type": "fact", "claims": [], "overall_confidence": 1}'
    closed = []

    def model(prompts):
        bad = F.col("prompt_id").endswith("1:0") & (F.col("attempt") == 1)
        return prompts.select("content_id", "phase", "prompt_id", "part", "attempt", F.when(bad, "no").otherwise(F.lit(good)).alias("raw_output"), F.lit(None).cast("string").alias("error_type"))

    model.close = lambda: closed.append(len(_standing(spark)))
    spark.conf.unset(NAME)
    tables, shuffles = _standing(spark), _shuffles(spark)
    out = jobs.run(rows, runs._tables(spark), model, runs.as_of())
    folder = lineage.shared_folder(spark)
    left = [set(spark.read.parquet(f"{folder}/{t}").columns) for t in _standing(spark) - tables]
    assert left and not [c for c in left if c & {"raw_output", "chunk", "prompt", "markdown"}] and len(closed) == 1
    assert sum("raw_text" in c for c in left) == 1 and not any(c == {"content_id", "text"} for c in left)
    until = time.monotonic() + 20
    while _shuffles(spark) - shuffles and time.monotonic() < until:
        time.sleep(0.2)
    assert not _shuffles(spark) - shuffles
    assert NAME not in spark.conf.getAll
    # Every result can still be read, twice.
    for _ in range(2):
        assert {(r.outcome, r["count"]) for r in out["outcomes"].groupBy("outcome").count().collect()} == {("completed", 20), ("duplicate", 4)}
        assert {(r.status, r["count"]) for r in out["contents"].groupBy("status").count().collect()} == {("completed", 20)}
        assert out["steps"].count() == 20 * 13 + 4 * 3 and out["analyses"].count() == 20 and out["grounded"].count() == 0
        assert out["attempts"].filter("valid").count() == 20 and out["attempts"].filter("payload is not null").count() == 20
        noted = out["notes"].collect()
        assert len(noted) == 20 and all("It says so." in r.markdown and r.path for r in noted)
    said = {r.seq: r.detail for r in out["steps"].filter("step = 'render_markdown'").collect()}
    assert sorted(said.values()) == sorted(str(len(r.markdown.encode())) for r in noted)
    assert jobs.processing_results(out).filter("result like '%note_path%'").count() == 24


def test_shuffles_stay_where_the_session_says_so(spark):
    spark.conf.set(NAME, "false")
    try:
        with lineage.short_shuffles(spark):
            assert spark.conf.get(NAME) == "false"
        assert spark.conf.get(NAME) == "false"
    finally:
        spark.conf.unset(NAME)
