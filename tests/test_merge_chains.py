"""Chains of merges: the sequential process, in few rounds."""

import random

from pyspark.sql import functions as F

from groundwork.operators import entities
from tests.test_text_and_tables import sequential_merges


def check(spark, names, owner, links, asks):
    e = spark.createDataFrame([(i, n, "other", None) for i, n in names.items()], "id string, canonical_name string, entity_type string, description string")
    a = spark.createDataFrame([(str(n), o, f) for n, (f, o) in enumerate(owner.items())], "id string, entity_id string, alias string")
    l = spark.createDataFrame([(*k, v) for k, v in links.items()], "content_id string, entity_id string, confidence double")
    got = entities.apply_merges(spark.createDataFrame(asks, "seq long, source_id string, target_id string, delete_source boolean, dry_run boolean"), e, a, l)
    left, owned, linked = sequential_merges(asks, dict(names), dict(owner), dict(links))
    assert {r.id: r.canonical_name for r in got[0].collect()} == left
    assert sorted((r.alias, r.entity_id) for r in got[1].collect()) == sorted(owned.items())
    assert {(r.content_id, r.entity_id): r.confidence for r in got[2].collect()} == linked


def test_a_chain_of_a_thousand(spark, monkeypatch):
    rounds, real = [], entities.checkpointed
    monkeypatch.setattr(entities, "checkpointed", lambda df: rounds.append(1) or real(df))
    n = 1000
    names = {f"e{i}": f"E{i}" for i in range(n + 1)}
    owner = {f"a{i}": f"e{i}" for i in range(0, n, 3)} | {f"E{n}": f"e{n // 2}", "E7": "e8"}
    links = {(f"c{i % 7}", f"e{i}"): i / n for i in range(0, n, 5)}
    check(spark, names, owner, links, [(i, f"e{i}", f"e{i + 1}", True, False) for i in range(n)])
    assert len(rounds) <= 40  # tables of one round and of one contraction, with ten jumps


def test_chains_among_other_requests(spark):
    """A chain with a leg, one whose middle is in conflict, one backwards, a ring, and links with confidences of their own."""
    names = {f"e{i}": f"E{i}" for i in range(24)}
    owner = {f"a{i}": f"e{i}" for i in range(0, 24, 2)} | {"E9": "e20", "E2": "e3"}
    links = {(f"c{(i * 7) % 5}", f"e{i}"): i / 100 for i in range(24)}
    pairs = [("e5", "e1"), ("e0", "e1"), ("e1", "e2"), ("e2", "e3"), ("e3", "e4"), ("e8", "e9"), ("e9", "e10"), ("e10", "e11"), ("e14", "e15"), ("e13", "e14"), ("e16", "e17"), ("e17", "e16"), ("e22", "e23")]
    check(spark, names, owner, links, [(n, s, t, s != "e22", False) for n, (s, t) in enumerate(pairs)])
