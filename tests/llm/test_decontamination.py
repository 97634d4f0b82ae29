"""Decontamination on repeated words, repeated ids and rows, and many short stretches."""

import time

from groundwork.llm import decontam


def frame(spark, rows, names):
    return spark.createDataFrame(rows, names)


def test_a_long_run_of_one_word_takes_seconds(spark):
    docs = frame(spark, [(1, "a " * 100_000), (2, "b " * 100_000), (3, "a b " * 50_000 + "a " * 10)], "doc_id long, text string")
    items = frame(spark, [(1, "a " * 400), (2, "c " * 400)], "item_id long, text string")
    decontam.contamination(docs.limit(0), items).count()
    began = time.time()
    got = {r.doc_id: r for r in decontam.contamination(docs, items).collect()}
    assert time.time() - began < 40
    assert (got[1].n_words, got[1].n_hit, got[1]["items"], len(got[1].spans)) == (100_000, 100_000, ["1"], 1)
    assert got[2].n_hit == 0 and (got[3].n_hit, got[3]["items"]) == (10, ["1"])


def test_rows_that_share_an_id_keep_their_own_results(spark):
    hit = "one two three four five six seven eight nine ten"
    rows = [(1, hit), (1, "other words"), (1, hit), (None, hit), (None, "clean"), (2, "x " + hit), (2, None)]
    docs = frame(spark, rows, "doc_id long, text string")
    items = frame(spark, [("a", hit), ("b", hit + " eleven"), (None, hit)], "item_id string, text string")
    got = decontam.contamination(docs, items).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, tuple(r["items"])) for r in got) == sorted(
        [("1", 10, 10, ("a", "b")), ("1", 2, 0, ()), ("1", 10, 10, ("a", "b")), ("None", 10, 10, ("a", "b")), ("None", 1, 0, ()), ("2", 11, 10, ("a", "b")), ("2", 0, 0, ())]
    )
    left = decontam.remove_contaminated(docs, items).collect()
    assert sorted(map(str, left)) == sorted(map(str, [r for r in docs.collect() if r.text in (None, "clean", "other words")]))


def test_many_stretches_and_sizes(spark):
    text = " ".join(f"p q r s{i}" for i in range(5000)) + " only"
    docs = frame(spark, [(1, text), (2, "q only")], "doc_id long, text string")
    items = frame(spark, [(1, "p Q r"), (2, "only"), (3, "q r s77"), (4, "p q r s1 p q r s2 p q r s3")], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.contamination(docs, items).collect()}
    want = brute(text, ["p q r", "only", "q r s77", "p q r s1 p q r s2 p q r s3"])
    assert (got[1].n_hit, got[1]["items"]) == (want, ["1", "2", "3", "4"])
    assert (got[2].n_hit, got[2]["items"]) == (1, ["2"])
    cut = {r.doc_id: r.text for r in decontam.remove_spans(docs, items.filter("item_id < 3")).collect()}
    assert cut[1].split() == [f"s{i}" for i in range(5000)] and cut[2] == "q "


def brute(text, items):
    ws, hit = text.split(), set()
    for item in items:
        its = item.split()
        n = min(10, len(its))
        windows = {tuple(its[i : i + n]) for i in range(len(its) - n + 1)}
        hit |= {i + k for i in range(len(ws) - n + 1) if tuple(ws[i : i + n]) in windows for k in range(n)}
    return len(hit)
