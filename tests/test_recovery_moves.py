"""Recovery moves what it runs again, and the scripted model's documents are dealt once."""

from pyspark.sql import functions as F

from groundwork.operators import jobs, warehouse
from groundwork.plans import derive, runs

SF = "/root/testdata/sf0.001"


def test_recovery_hands_on_what_is_stale_without_a_join(spark, monkeypatch):
    given = []

    def run(raw, tables, *_, **__):
        given.append((raw, tables))
        return {"outcomes": spark.createDataFrame([], "content_id string, outcome string, error_type string")}

    monkeypatch.setattr(jobs, "run", run)
    contents = derive.contents(spark, SF).withColumns({c: F.lit(None).cast("string") for c in ("source_url", "media_type", "error_message")}).withColumns({"error_type": F.lit("E"), "processed_at": runs.as_of()})
    lost = contents.limit(1).withColumns({"id": F.lit(None).cast("string"), "status": F.lit("processing")})
    contents = contents.unionByName(lost)
    old = {r.id for r in warehouse.stale(contents, runs.as_of()).select("id").collect()} - {None}
    _, recovered = jobs.recover({"contents": contents}, None, runs.as_of())
    raw, tables = given[0]
    assert old and {r.id for r in raw.select("id").collect()} == old
    assert {r.media_type for r in raw.select("media_type").distinct().collect()} == {"text"}
    assert "Join" not in raw._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.content_id, r.outcome) for r in recovered.select("content_id", "outcome").collect()} == {(i, "pending") for i in old | {None}}
    ids = warehouse.stale(contents, runs.as_of())
    by_ids = warehouse.reset_to_pending(contents, ids)
    facts = ("id", "status", "error_type", "error_message", "processed_at")
    assert sorted(map(str, tables["contents"].select(*facts).collect())) == sorted(map(str, by_ids.select(*facts).collect()))


def test_a_round_of_answers_moves_prompts_alone(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with runs._model(spark, SF) as model:
            prompts = runs._outputs(spark, SF).select("content_id", "phase", "prompt_id", "part", F.lit(1).alias("attempt"))
            told = model(prompts)
            assert len(told.collect()) == prompts.count()
            final = told._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            tree = final.split("InMemoryRelation")[0]
            assert "InMemoryTableScan" in tree and tree.count("Exchange hashpartitioning") == 1, final
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
