"""Extension points: models and media readers that fail, are missing, have bugs, or are played from a table."""

import pytest
from pyspark.sql import functions as F

from groundwork.operators import analyses, capabilities, jobs


def prompts(spark, n):
    return spark.range(n, numPartitions=2).select(F.col("id").alias("prompt_id"), F.concat(F.lit("p"), "id").alias("prompt"))


def test_only_prompts_without_an_answer_fail(spark):
    made = spark.sparkContext.accumulator(0)

    def factory():
        made.add(1)

        def ask(some):
            if "p7" in some:
                raise analyses.RequestFailed("LLM_TIMEOUT")
            return [None if p == "p3" else p.upper() for p in some]

        return ask

    got = {r.prompt_id: (r.raw_output, r.error_type) for r in analyses.infer(prompts(spark, 10), factory).collect()}
    assert got == {i: (None, "LLM_TIMEOUT") if i == 7 else (None, "LLM_REQUEST_FAILED") if i == 3 else (f"P{i}", None) for i in range(10)}
    assert made.value == 2 and analyses.infer(prompts(spark, 0), factory).count() == 0


def test_bugs_are_not_hidden(spark):
    with pytest.raises(Exception, match="ZeroDivisionError"):
        analyses.infer(prompts(spark, 3), lambda: lambda some: [1 / 0]).collect()
    with pytest.raises(Exception, match="3 prompts got 1 answers|2 prompts got 1 answers"):
        analyses.infer(prompts(spark, 3).coalesce(1), lambda: lambda some: ["x"]).collect()


def readers():
    """Classes of this function, so that they go to the workers by value."""

    class Reader:
        name = "reader"

        def is_available(self):
            return True

        def text_of(self, content, path):
            if content == b"bad":
                raise capabilities.CapabilityError("MEDIA_BROKEN")
            return content.decode() if content != b"none" else None

    class Missing(Reader):
        name = "missing"

        def is_available(self):
            return False

    class Bug(Reader):
        def text_of(self, content, path):
            return content + "x"

    return Reader, Missing, Bug


Reader, Missing, Bug = readers()


def files(spark, tmp_path):
    for name, content in (("a.png", b"seen"), ("b.png", b"bad"), ("c.png", b"none"), ("d.png", b" "), ("e.mp4", b"x"), ("f.txt", b"y")):
        (tmp_path / name).write_bytes(content)
    found = spark.read.format("binaryFile").load(str(tmp_path))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("path"), "content").withColumn("capability", F.when(F.col("path").endswith("png"), "ocr").when(F.col("path").endswith("mp4"), "transcribe"))


def test_attempts(spark, tmp_path):
    assets = files(spark, tmp_path).unionByName(spark.createDataFrame([("g.png", None, "ocr")], "path string, content binary, capability string"))
    told = lambda factories: {r.path: (r.provider, r.status, r.text, r.error_type) for r in capabilities.extracted_text(assets, factories).collect()}
    assert told({"ocr": Reader, "transcribe": Missing}) == {
        "a.png": ("reader", "ok", "seen", None), "b.png": ("reader", "failed", None, "MEDIA_BROKEN"), "c.png": ("reader", "skipped", None, None), "d.png": ("reader", "skipped", None, None),
        "e.mp4": ("missing", "unavailable", None, "CAPABILITY_UNAVAILABLE"), "f.txt": ("none", "skipped", None, None), "g.png": ("reader", "skipped", None, None),
    }
    assert {(p, s) for p, s, *_ in told({}).values()} == {("none", "unavailable"), ("none", "skipped")}
    with pytest.raises(Exception, match="TypeError"):
        capabilities.extracted_text(assets, {"ocr": Bug}).collect()


def test_enrichment_by_provider_and_by_table(spark, tmp_path):
    raw = spark.createDataFrame([("s", "1", "image", "a.png", None, None), ("s", "2", "image", "b.png", None, None), ("s", "3", "video", "e.mp4", None, None), ("s", "4", "image", "a.png", None, "had")], "source string, source_id string, media_type string, media_path string, transcript string, ocr_text string")
    out, attempts = jobs.enriched(raw, capabilities.extracted_text(files(spark, tmp_path), {"ocr": Reader}))
    assert {r.source_id: r.ocr_text for r in out.collect()} == {"1": "seen", "2": None, "3": None, "4": "had"}
    assert {r.source_id: (r.status, r.error_type) for r in attempts.collect()} == {"1": ("ok", None), "2": ("failed", "MEDIA_BROKEN"), "3": ("unavailable", None), "4": ("skipped", None)}
    script = spark.createDataFrame([("e.mp4", "transcribe", "ok", "heard", None), ("b.png", "ocr", "failed", None, "X")], "path string, capability string, status string, text string, error_type string")
    out, attempts = jobs.enriched(raw, capabilities.scripted_text(files(spark, tmp_path), script))
    assert {r.source_id: r.transcript for r in out.collect()} == {"1": None, "2": None, "3": "heard", "4": None}
    assert {r.source_id: r.status for r in attempts.collect()} == {"1": "unavailable", "2": "failed", "3": "ok", "4": "skipped"}
