"""Signatures of a text are made once, and ranked once for both sides of the join."""

from groundwork.llm import spotsigs

SF = "/root/testdata/sf0.001"


def test_signatures_are_made_and_ranked_once(spark, monkeypatch):
    plans = []

    def stored(df, real=spotsigs.stored):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df)

    monkeypatch.setattr(spotsigs, "stored", stored)
    pairs, _ = spotsigs.similar_pairs(spark.read.parquet(f"{SF}/documents.parquet"))
    assert plans[0].count("regexp_replace(lower(") == 1
    assert "Window" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Window" in p for p in plans) == 1
