"""The language stage decides by the model: languages that were not learned and junk go, all else stays."""

import random

from pyspark.sql import functions as F

from groundwork.llm import langid

SF = "/root/testdata/sf0.01"


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_documents_of_a_language_that_was_not_learned_go(spark):
    docs = docs_of(spark)
    whole, part = langid.train_on(docs), langid.train_on(docs.filter("lang <> 'de'"))
    assert whole[0] == ["de", "en", "es", "fr"] and part[0] == ["en", "es", "fr"]
    count = lambda model: {r.lang: r["count"] for r in langid.keep_identified(docs, model).groupBy("lang").count().collect()}
    every = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}
    assert count(whole) == every  # clean documents stay
    left = count(part)
    assert left.get("de", 0) <= 0.1 * every["de"] and all(left[x] == every[x] for x in ("en", "es", "fr"))


def test_junk_goes_and_mixtures_stay(spark):
    rnd = random.Random(3)
    docs = docs_of(spark)
    model = langid.MixtureModel(*langid.train_on(docs), 3.0, 6)
    junk = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(300)) for _ in range(20)] + ["это русский текст " * 20, "中文文本" * 40]
    assert not any(x[3] for x in model.predict(junk)) and model.predict(["..."])[0][:2] == ("und", 0.0)
    long = {r.lang: r.text for r in docs.filter("n_chars between 1500 and 2500").select("lang", "text").collect()}
    assert all(x[3] for x in model.predict([long["en"] + " " + long["de"], "the", "der", "xq"]))


def test_em_finds_the_proportions_that_maximise_the_likelihood(spark):
    """The mixture of two languages against a grid search over their proportions."""
    import numpy as np

    docs = docs_of(spark)
    langs, table = langid.train_on(docs.filter("lang in ('en', 'fr')"))
    texts = {r.lang: r.text[:700] for r in docs.filter("n_chars > 800 and lang in ('en', 'fr')").select("lang", "text").collect()}
    words = langid.words_of(texts["en"] + " " + texts["fr"] + " " + texts["fr"])
    found = {x[0]: x[1] for x in langid.MixtureModel(langs, table, 3.0, 60).predict([" ".join(w.decode() for w in words)])[0][2]}
    at, sizes = langid.trigrams(words)
    scores = np.add.reduceat(table[at].astype(np.float64), np.cumsum(sizes) - sizes, axis=0)
    grid = np.linspace(0.001, 0.999, 999)
    value = [np.logaddexp(scores[:, 0] + np.log(g), scores[:, 1] + np.log(1 - g)).sum() for g in grid]
    assert langs == ["en", "fr"] and abs(found["en"] - grid[int(np.argmax(value))]) < 0.02


def test_fits_is_a_column(spark):
    docs = docs_of(spark).limit(50).withColumn("fits", F.lit(1))
    assert langid.identify(docs, langid.train_on(docs)).columns == ["doc_id", "lang_pred", "score", "languages", "fits"]
