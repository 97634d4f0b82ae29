"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from groundwork.llm import bpe, chat, decontam, html_text, langid, licenses, near_dedup, secrets, spotsigs, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = SCHEMA + ", id long, spans string, n_words long, bucket string, sigs string, component_id long, __doc string"
LONG = "word and the wörd " * 20_000
ROWS = [
    (1, None, "en", "s", None),
    (2, "", "en", "s", 0),
    (3, "the quick brown fox and the lazy dog of the house", "en", "s", 49),
    (3, "the quick brown fox and the lazy dog of the house", "en", "s", 49),
    (4, LONG, None, None, len(LONG)),
    (5, " \t\n ", "de", "s", 4),
    (6, "12345 !!", "de", "s", 8),
    (None, "no id here at all", "fr", "s", 17),
]
ITEMS = [(1, "the quick brown fox and the lazy dog of the house"), (2, None), (3, ""), (4, "lazy dog"), (4, "lazy dog")]


@pytest.fixture(params=["plain", "extra", "empty"])
def docs(spark, request):
    if request.param == "empty":
        return spark.createDataFrame([], SCHEMA)
    if request.param == "extra":
        return spark.createDataFrame([(*r, 9, "x", 9, "b", "s", 9, "d") for r in ROWS], EXTRA)
    return spark.createDataFrame(ROWS, SCHEMA)


def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def vocabulary():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_licenses(docs):
    got = by_id(licenses.scan_licenses(docs))
    if got:
        assert len(got[3]) == 2 and got[1][0].n_words == 0 and got[2][0].spans == [] and got[4][0].n_words == 80_000


def test_bpe(docs):
    got = by_id(bpe.encode_decode(docs, ranks(), public_tokenizers.PATTERN))
    if got:
        assert got[1][0].n_tokens == got[2][0].n_tokens == 0 and bytes(got[4][0].decoded).decode() == LONG and len(got[3]) == 2


def test_token_counts(docs):
    got = by_id(token_counts.count_tokens(docs, vocabulary()))
    if got:
        assert got[1][0].n_tokens == 0 and got[5][0].n_tokens == 0 and got[5][0].n_bytes == 4


def test_secrets(docs):
    got = by_id(secrets.scan_secrets(docs))
    if got:
        assert all(r.spans == [] for rows in got.values() for r in rows)
    redacted = secrets.redact_secrets(docs)
    assert redacted.columns == docs.columns and redacted.count() == docs.count()
    assert redacted.filter("doc_id = 1 and text is not null").isEmpty()


def test_language(docs):
    model = langid.train_on(docs)
    got = by_id(langid.identify(docs, model))
    if got:
        assert [got[i][0].lang_pred for i in (1, 2, 5, 6)] == ["und"] * 4 and all(0 <= r.score <= 1 for rows in got.values() for r in rows)
        assert {r.doc_id for r in langid.keep_identified(docs, (["en"], model[1][:, :1] * 0)).collect()} == {3, 4, None}
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns


def test_decontamination(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = by_id(decontam.contamination(docs, items))
    if got:
        assert got[3][0].n_hit == 11 and got[3][0]["items"] == ["1", "4"] and len(got[3]) == 2 and got[4][0].n_hit == 0 and got[1][0].n_words == 0
    kept = decontam.remove_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.filter("doc_id = 3").isEmpty()
    assert decontam.contamination(docs, items.limit(0)).filter("n_hit > 0").isEmpty()
    far = decontam.contamination(docs, items, broadcast_bytes=0)  # beyond the bound: a shuffle join, the same rows
    assert sorted(map(str, far.collect())) == sorted(str(r) for rows in got.values() for r in rows)


def test_near_duplicates(docs):
    got = by_id(near_dedup.near_duplicates(docs))
    if got:
        assert [(r.component_id, r.kept) for r in got[3]] == [(3, True)] * 2 and got[1][0].n_shingles == 0 and got[1][0].kept and got[5][0].component_id == 5


def test_spots(docs):
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("sigs", spotsigs.signatures(F.col("text")))
    got = by_id(spotsigs.with_next(rows, "doc_id", ["text", "sigs"]))
    if got:
        assert got[1][0].sigs == [] and got[1][0].next_text == "12345 !!"
        assert got[2][0].next_text == "" and got[4][0].next_text == ROWS[2][1] and got[None][0].next_text is None
    pairs, members = spotsigs.similar_pairs(docs)
    assert pairs.isEmpty() and members.columns == ["id", "representative"]
    alone = spotsigs.linked_classes(docs)
    assert alone.columns == ["id", "representative", "n_links", "closest"] and alone.filter("n_links > 0").isEmpty() and alone.count() == docs.count()


def test_chat(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_chats(none)).isEmpty()
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 0, "assistant", "x")]
    extra = spark.createDataFrame([(*r, 1, "w") for r in rows], "conv_id long, turn long, role string, text string, window long, shown string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(extra)).collect()}
    assert got[1].texts == ["", "a", "a"] and got[None].targets == ["x"]


def test_html(spark):
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, html string")).isEmpty()
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (3, "<p>" * 3000 + "deep", "x"), (4, "<b" * 2000, "x")]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()}
    assert got[1] == got[2] == "" and got[3] == "deep"
