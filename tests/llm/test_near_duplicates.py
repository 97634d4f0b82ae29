"""Near-duplicate groups under skew: mostly empty texts, mostly one text, ids with several texts."""

import random

from pyspark.sql import functions as F

from groundwork.llm import near_dedup


def test_text_hash_is_sparks(spark):
    df = spark.createDataFrame([(i, "ä word " * i) for i in range(60)] + [(99, None)], "doc_id long, text string")
    got = {r.id: r.text_hash for r in near_dedup.signatures(df).collect()}
    assert got == {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit("")).cast("binary")).alias("h")).collect()}


def test_most_rows_empty_or_equal(spark):
    rows = [(i, "" if i % 10 else None) for i in range(3000)] + [(i, "one and the same text of many words") for i in range(3000, 6000)]
    rows += [(6000, "one and the same text of many other words"), (6001, "quite another text that has nothing in common"), (None, "one and the same text of many words"), (None, None)]
    got = {r.doc_id: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id is not None}
    assert len(got) == 6002 and all(got[i].component_id == i and got[i].kept and got[i].n_shingles == 0 for i in range(3000))
    assert all(got[i].component_id == 3000 for i in range(3000, 6000)) and sum(r.kept for r in got.values()) == 3003


def test_an_id_with_two_texts_links_their_groups(spark):
    rnd = random.Random(1)
    a, b, c = (" ".join(f"{x}{rnd.randrange(1000)}" for _ in range(60)) for x in "abc")
    near_b = b + " more"
    rows = [(1, a), (1, b), (5, b), (6, b), (7, near_b), (8, c), (0, c), (9, a), (8, "short text"), (10, "short text")]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    group = {i: comp for (i, _), comp in got.items()}
    assert group == {1: 1, 5: 1, 6: 1, 7: 1, 9: 1, 0: 0, 8: 0, 10: 0}


def test_blocks_of_many_shingles_are_split(spark):
    """Long near copies around two centres that the stars can't join: parts of few shingles give the same groups."""
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(900)}" for _ in range(400)]
    rows = []
    for i in range(60):
        words = list(base)
        for k in rnd.sample(range(400), rnd.choice((2, 8, 12))):
            words[k] = f"e{i}x{k}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    assert want == {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, block=8, part_shingles=1500).collect()}


def test_a_low_similarity_needs_more_slots_than_a_byte_numbers(spark):
    """Slots of disjoint sets differ at every number of slots; pairs at 50 % are those of all full sets."""
    import numpy as np

    rnd = np.random.default_rng(2)
    for similarity in (0.85, 0.6, 0.5, 0.3):
        m = near_dedup.bands_for(similarity, 1e-6) * near_dedup.SLOTS
        sets = [rnd.integers(0, 2**63, 400, dtype=np.uint64) for _ in range(2)]
        one, two = near_dedup.super_min_hash(np.concatenate(sets), np.repeat([0, 1], 400), 2, m)
        assert (one == two).mean() < 0.005, (similarity, m)
    texts = []
    for i in range(40):
        words = [f"w{rnd.integers(0, 900)}" for _ in range(40)]
        texts += [(3 * i + k, " ".join(words[: 40 - 5 * k] + [f"x{i}{k}{j}" for j in range(5 * k)])) for k in range(3)]
    sets = {i: {tuple(w[j : j + 3]) for j in range(len(w) - 2)} for i, t in texts for w in [t.split()]}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 50 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = near_dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), words=3, percent=50).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in sets}
