"""Scripted answers over documents without a text: the contract refuses blank claims, but a blank document makes none."""

import os

import pytest
from pyspark.sql import functions as F

from groundwork.operators import analyses
from groundwork.plans import reports, runs

SF = "/root/testdata/sf0.001"
BLANK = {3: "", 4: " ", 8: "\n", 12: None, 15: "", 16: "=", 24: "-"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Forty documents, some of them blank or null."""
    d = str(tmp_path_factory.mktemp("blank"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 40")
    other = spark.createDataFrame(list(BLANK.items()), "doc_id long, other string").withColumn("odd", F.lit(True))
    docs.join(other, "doc_id", "left").withColumn("text", F.when(F.col("odd"), F.col("other")).otherwise(F.col("text"))).drop("other", "odd").write.parquet(os.path.join(d, "documents.parquet"))
    return d


def test_claims_of_blank_documents_come_out_as_they_are(spark, folder):
    texts = {str(r.doc_id): r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if r.doc_id % 8 not in (5, 6)}
    assert {r.content_id: r.text for r in runs.g3_unnest_whole(spark, folder).collect()} == texts and len(texts) == 30
    cut = {r.content_id: r.text for r in runs.g3_unnest(spark, folder).collect()}
    assert cut.keys() == texts.keys() and cut["3"] == "" and cut["4"] == " " and cut["8"] == " " and cut["12"] is None and cut["16"] == "=" and cut["24"] == "-"


def test_blank_documents_keep_the_contract(spark, folder):
    assert {(r.valid, r.summary, r.n) for r in runs.k7_contract(spark, folder).collect()} == {(True, "", 30), (False, "enum:analysis_type", 5), (False, "parse", 5)}
    rounds = {(r.attempt, r.n, r.n_failed, r.n_repaired) for r in runs.k8_retry_rounds(spark, folder).collect()}
    assert rounds == {(1, 40, 10, 20), (2, 10, 5, 0), (3, 5, 5, 0)}


def test_a_blank_document_breaks_one_rule_alone(spark, folder):
    n = len(reports.BREAKS) + 1
    told = {r.doc_id: r.codes for r in reports.k7_every_code(spark, folder).collect()}
    assert told == {i: ",".join(reports.MANY) if i % n == n - 1 else reports.BREAKS[i % n] for i in range(40)}


def test_the_contract_still_refuses_blank_claims(spark):
    said = '{"title": "t", "summary": "s", "analysis_type": "fact", "claims": [{"text": "%s", "type": "fact", "confidence": 1}], "overall_confidence": 1}'
    rows = spark.createDataFrame([(said % "",), (said % " ",), (said % "=",)], "payload string")
    assert [r.v for r in rows.select(analyses.violations(F.col("payload")).alias("v")).collect()] == [["blank:claims.text"], ["blank:claims.text"], []]
