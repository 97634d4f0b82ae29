"""Duplicates that hang on each other by alternating keys: the sequential rule, in few rounds."""

import random

from pyspark.sql import functions as F

from groundwork.operators import dedup
from tests.test_text_and_tables import sequential_dedup


def frame(spark, rows):
    return spark.createDataFrame(rows, "seq long, source string, source_id string, content_hash string, discriminating boolean").withColumn("content_hash_version", F.lit(2))


def result(df):
    return {r.seq: (r.kept, r.duplicate_of) for r in df.collect()}


def test_a_chain_of_ten_thousand(spark, monkeypatch):
    rounds, real = [], dedup.checkpointed
    monkeypatch.setattr(dedup, "checkpointed", lambda df: rounds.append(1) or real(df))
    n = 10_000
    rows = [(i, "s", f"i{(i + 1) // 2}", f"h{i // 2}", True) for i in range(n)]
    got = result(dedup.within_batch(frame(spark, rows)))
    assert len(rounds) - 5 <= 16  # the tables of keys, leaders, links, open rows (twice), and the jumps: 2 ** 14 > n, and one that finds nothing to do
    assert got == {i: (i % 2 == 0, None if i % 2 == 0 else i - 1) for i in range(n)}


def test_chains_with_side_branches_equal_the_sequential_rule(spark):
    rnd = random.Random(11)
    for k in range(4):
        rows, n = [], 0
        for _ in range(6):  # chains of many lengths, some joined at a row that has two before it, and hot keys
            for i in range(rnd.randrange(1, 25)):
                rows.append((f"s{k}", f"i{n + (i + 1) // 2}", f"h{n + i // 2}", rnd.random() < 0.95))
            n += 30
        rows += [(f"s{k}", f"i{rnd.randrange(n)}", f"h{rnd.randrange(n)}", True) for _ in range(40)]
        rows += [(f"s{k}", "i3", f"h{rnd.randrange(9)}", True) for _ in range(10)] + [(f"s{k}", f"i{rnd.randrange(9)}", "h4", True) for _ in range(10)]
        if k % 2:
            rnd.shuffle(rows)
        rows = [(i, *r) for i, r in enumerate(rows)]
        assert result(dedup.within_batch(frame(spark, rows))) == sequential_dedup(rows)
