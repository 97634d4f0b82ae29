"""The pipeline's stages on odd tables, and all of them after each other on documents with planted rows."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from groundwork.llm.bpe import read_ranks

SF = "/root/testdata/sf0.001"
UUID = "123e4567-e89b-12d3-a456-426614174000"
KEY = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def with_rows(spark, docs, *rows):
    """docs and rows (doc_id, text), whose lang and source are null."""
    return docs.unionByName(spark.createDataFrame([(i, t, len(t) if t else 0) for i, t in rows], "doc_id long, text string, n_chars int").selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "CAST(NULL AS STRING) AS source", "n_chars"))


def test_stages_on_odd_tables(spark, docs):
    words = docs.orderBy("doc_id").first().text
    odd = with_rows(spark, docs, (None, words + " and more"), (9001, None), (9002, ""), (9003, words), (9003, words))
    odd = odd.selectExpr("*", "'x' AS id", "1 AS spans", "doc_id AS kept", "text AS items").repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        assert name == "byte_bpe" or out.columns == odd.columns
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        expect = {"language_id": {9001: 0, 9002: 0}, "near_dedup": {9001: 1, 9002: 1, 9003: 0}}.get(name, {9001: 1, 9002: 1, 9003: 2})
        assert all(ids.count(i) == n for i, n in expect.items()) and ids.count(None) == 1, name
        assert stage(spark, odd.limit(0), SF).count() == 0
    bare = docs.select("doc_id", "text")
    assert corpus_pipeline.secret_scan(spark, bare, SF).columns == ["doc_id", "text"]


def test_the_whole_pipeline_on_planted_rows(spark, docs, tmp_path):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    clean = [r.text for r in docs.filter("n_chars between 400 and 2000").orderBy("doc_id").limit(3).collect()]
    rnd = random.Random(1)
    words = clean[0].split()
    near = " ".join(w if rnd.random() > 0.005 else w + "s" for w in words)
    rows = [(90001, clean[0]), (90002, near), (90003, f"{clean[1]} {item} {clean[2]}"), (90004, " ".join(reversed(clean[1].split())) + f" request {UUID} done"), (90005, " ".join(reversed(clean[2].split())) + f' token = "{KEY}" done'), (90006, None), (90007, "")]
    with_rows(spark, docs, *rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not {90001, 90002, 90003, 90006, 90007} & got.keys() and {90004, 90005} <= got.keys()
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path(corpus_pipeline.RANKS)), special_tokens={})
    for i, text in ((90004, dict(rows)[90004]), (90005, " ".join(reversed(clean[2].split())) + ' [SECRET]" done')):
        ids = encoding.encode_ordinary(text)
        assert bytes(got[i].token_ids) == b"".join(x.to_bytes(4, "little") for x in ids) and got[i].n_tokens == len(ids)
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
