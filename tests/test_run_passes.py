"""How often a run reads and asks: texts are fingerprinted once, nothing is merged that is whole."""

from pyspark.sql import functions as F

from groundwork.functions import text
from groundwork.operators import analyses, jobs
from groundwork.plans import runs

GOOD = '{"title": "t", "summary": "s", "analysis_type": "fact", "claims": [], "overall_confidence": 1}'


def _model(asked):
    def model(prompts):
        asked.append({r.phase for r in prompts.select("phase").distinct().collect()})
        return prompts.select("content_id", "phase", "prompt_id", "part", "attempt", F.lit(GOOD).alias("raw_output"), F.lit(None).cast("string").alias("error_type"))

    return model


def test_a_run_makes_texts_twice_and_merges_nothing_that_is_whole(spark):
    made = spark.sparkContext.accumulator(0)

    def say(i):
        made.add(1)
        return f"text {i % 9}"

    rows = spark.range(12).select(F.col("id").alias("seq"), F.lit("s").alias("source"), F.col("id").cast("string").alias("source_id"))
    raw = rows.withColumn("raw_text", F.udf(say, "string").asNondeterministic()(F.col("seq")))
    asked = []
    out = jobs.run(raw, runs._tables(spark), _model(asked), runs.as_of())
    assert {(r.outcome, r["count"]) for r in out["outcomes"].groupBy("outcome").count().collect()} == {("completed", 9), ("duplicate", 3)}
    assert out["steps"].count() == 9 * 13 + 3 * 3
    assert made.value == 24  # once for the fingerprints, once for what the run works on
    assert asked == [{"analysis"}]
    assert out["notes"].columns[-3:] == ["markdown", "path", "path_error"] and out["notes"].filter("markdown is not null and path is not null").count() == 9


def test_contents_in_parts_are_still_merged(spark):
    parts = spark.createDataFrame([("a", 0, 2, "x"), ("a", 1, 2, "y"), ("b", 0, 1, "z")], "content_id string, chunk_index int, chunk_total int, chunk string")
    asked = []
    results, log = analyses.analyse(parts, _model(asked))
    assert {(r.content_id, r.chunk_count, r.payload, r.error_type) for r in results.collect()} == {("a", 2, GOOD, None), ("b", 1, GOOD, None)}
    assert asked == [{"analysis"}, {"synthesis"}] and log.count() == 4


def test_cleaning_tells_what_it_took(spark):
    given = [("a\r\nb", True, False), ("a​b\r", True, True), ("é", False, False), ("plain", False, False), (None, False, False)]
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(given)], "i int, t string").select("i", text.clean_source_text(F.col("t")).alias("c")).orderBy("i").collect()
    assert [(r.c.newline_normalized, r.c.zero_width_removed) for r in rows] == [x[1:] for x in given]
    assert [r.c.text for r in rows] == ["a\nb", "ab", "é", "plain", ""]
