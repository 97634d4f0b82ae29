"""Notes are made in their row, and names from the start of a title where that is enough."""

from pyspark.sql import functions as F

from groundwork.functions import names, text
from groundwork.plans import bodies

SF = "/root/testdata/sf0.001"


def test_notes_are_made_in_their_row(spark):
    plan = bodies.k12_bodies(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_names_of_titles_whose_start_says_little(spark):
    long = names.HEAD
    given = ["", "." * (long + 9) + "a", " " * (long + 9) + "b c", "/" * (long + 9) + "con", "x" * 90, "x" * 79 + " ." * long, "y. " * long, "q" + "​" * long + "r" * 100, "CON.txt", "a" * 60 + "?" * long + "b" * 60]
    legal = lambda x: F.regexp_replace(F.regexp_replace(x, f"[{text.ZERO_WIDTH}]", ""), names._ILLEGAL, "")
    all_of_it = names._bare(F.substring(names._bare(F.regexp_replace(legal(F.col("t")), r"(?U)\s+", " ")), 1, names.MAX_NAME))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").select("i", names.file_name(F.col("t"), F.lit("id")).alias("name"), all_of_it.alias("whole")).collect()
    assert [r.name for r in sorted(rows)] == [{"": "id", "con": "_con", "CON.txt": "_CON.txt"}.get(r.whole, r.whole) for r in sorted(rows)]
