"""What a run is planned as: empty tables cost no task, generated methods are small enough to be compiled, white space is looked at once."""

from pyspark.sql import functions as F

from groundwork.functions import names, text
from groundwork.operators import lineage, notes
from groundwork.plans import runs


def test_joins_with_empty_tables_are_planned_away(spark):
    rows = spark.range(3).select(F.col("id").cast("string").alias("id"))
    joined = rows.join(runs._tables(spark)["contents"].select("id", "status"), "id", "left")
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "LogicalRDD" not in plan
    assert {(r.id, r.status) for r in joined.collect()} == {("0", None), ("1", None), ("2", None)}


def test_rendering_asks_for_small_methods_unless_the_session_has_said(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    rows = spark.createDataFrame([("a", "t")], "content_id string, raw_text string")
    spark.conf.unset(name)
    notes.render_notes(rows)
    assert spark.conf.get(name) == str(lineage.METHOD_BYTES)
    spark.conf.set(name, "9000")
    notes.render_notes(rows)
    assert spark.conf.get(name) == "9000"
    spark.conf.unset(name)


def test_white_space_comes_out_as_before(spark):
    given = ["", " ", "a b", "a  b", " a\n", "\na \tb\r\n", "a　b", "a   b", "\x1ca\x1c b\x85", "a\n\nb \n c", "x ", "`` ` a` \n ", "é  ```` ", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    t = F.coalesce("t", F.lit(""))
    old_line, old_end = F.trim(F.regexp_replace(t, r"(?U)\s+", " ")), F.regexp_replace(t, r"(?U)\s+$", "")
    marks = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(F.transform(F.regexp_extract_all(t, F.lit("`+"), F.lit(0)), F.length)), F.lit(0)) + 1))
    old_fence = F.concat(marks, F.lit("text\n"), old_end, F.lit("\n"), marks)
    bad = rows.filter((text.one_line(F.col("t")) != old_line) | (names.fenced(t) != old_fence))
    assert bad.count() == 0
    assert text.RUNS != r"(?U)\s+" and rows.filter(F.col("t") == "a b").select(F.regexp_replace("t", text.RUNS, "_")).first()[0] == "a b"
