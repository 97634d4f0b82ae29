"""Commits of several tables: whole or not at all, two writers, writers that are lost."""

import pytest
from pyspark.sql import functions as F

from groundwork.operators import warehouse

TOPIC = "id string, name string"


def names(store, version=None):
    return sorted(r.name for r in store.read("topics", version).collect())


def topics(spark, *of):
    return spark.createDataFrame([(x, x) for x in of], TOPIC)


def contents(spark, *ids):
    rows = spark.createDataFrame([(i,) for i in ids], "id string").withColumns({"source": F.lit("s"), "source_id": F.col("id")})
    return rows.withColumns({c: F.lit(None) for c in (x.split()[0] for x in warehouse.SCHEMAS["contents"].split(", ")) if c not in rows.columns})


def analyses(spark, *rows):
    made = spark.createDataFrame(rows, "id string, content_id string, day int").withColumn("created_at", F.make_timestamp(F.lit(2024), F.lit(1), F.col("day"), F.lit(0), F.lit(0), F.lit(0))).drop("day")
    return made.withColumns({c: F.lit(None) for c in (x.split()[0] for x in warehouse.SCHEMAS["analyses"].split(", ")) if c not in made.columns})


def test_two_writers_of_one_number(spark, tmp_path):
    one, two = (warehouse.Warehouse(spark, str(tmp_path)) for _ in range(2))
    one.write("topics", topics(spark, "a"))
    base = two.version()
    one.append("topics", topics(spark, "b"))
    with pytest.raises(warehouse.Conflict):  # made from what has changed since
        two.commit(replaced={"topics": topics(spark, "x")}, base=base)
    assert names(one) == ["a", "b"] and names(one, base) == ["a"]
    # the second writer looks before the first one has committed, and both want the same number
    true_version, seen = two.version, [one.version()]
    one.append("topics", topics(spark, "c"))
    two.version = lambda: seen.pop() if seen else true_version()
    two.commit(added={"topics": topics(spark, "d")}, base=base)
    assert names(one) == ["a", "b", "c", "d"] and one.version() == 4
    seen.append(3)
    with pytest.raises(ValueError):  # what the other has added meanwhile counts
        two.commit(added={"topics": topics(spark, "d")}, base=3)
    assert not one._name(4, {}) and names(one) == ["a", "b", "c", "d"]


def test_a_writer_that_is_lost_between_tables_changes_nothing(spark, tmp_path):
    store = warehouse.Warehouse(spark, str(tmp_path))
    store.commit(replaced={"topics": topics(spark, "a"), "contents": contents(spark, "1", "2")})
    lost = topics(spark, "z").withColumn("name", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.commit(replaced={"contents": contents(spark, "9"), "topics": lost})
    twice = topics(spark, "b").unionByName(topics(spark, "b"))
    with pytest.raises(ValueError):
        store.commit(replaced={"contents": contents(spark, "9")}, added={"topics": twice})
    assert names(store) == ["a"] and store.read("contents").count() == 2 and store.version() == 1
    assert len(list((tmp_path / "contents").iterdir())) == 3  # written, but never named


def test_analyses_and_pointers_go_together(spark, tmp_path):
    store = warehouse.Warehouse(spark, str(tmp_path))
    store.write("contents", contents(spark, "1", "2"))
    pointers = lambda: {r.id: r.current_analysis_id for r in store.read("contents").collect()}
    store.save_analyses(analyses(spark, ("a1", "1", 1), ("a2", "1", 2)))
    assert pointers() == {"1": "a2", "2": None}
    with pytest.raises(ValueError):
        store.save_analyses(analyses(spark, ("a3", "2", 1), ("a4", "7", 1)))
    assert pointers() == {"1": "a2", "2": None} and store.read("analyses").count() == 2
    store.save_analyses(analyses(spark, ("a2", "1", 2), ("a5", "2", 3)))  # a run that is repeated, and goes on
    assert pointers() == {"1": "a2", "2": "a5"} and store.read("analyses").count() == 3
    other = warehouse.Warehouse(spark, str(tmp_path))
    base = other.version()
    store.save_analyses(analyses(spark, ("a6", "2", 4)))
    with pytest.raises(warehouse.Conflict):
        other.commit(replaced={"contents": contents(spark, "1", "2")}, base=base)
    assert pointers() == {"1": "a2", "2": "a6"}
