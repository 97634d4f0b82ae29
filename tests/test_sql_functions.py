"""Functions registered for SQL give what the column expressions give."""

import random

from pyspark.sql import functions as F

from groundwork import sql
from groundwork.functions import text
from groundwork.operators import numbers


def some_texts():
    rng = random.Random(4)
    letters = [*"ab 1.%", "\t", "\n", "\r", "\x0b", "\x1c", "\x85", " ", " ", " ", "​", " ", "﻿", "　", "ß", "İ", "ﬁ", "Ａ", "é", "é", "百", "三", "万", "多", "٣"]
    return [None, "", *("".join(rng.choice(letters) for _ in range(rng.randrange(0, 25))) for _ in range(400)), "1" * 40 + " " + "9" * 27, "三百多万 12.5% 3 亿 百分之四十"]


def test_scalar_functions(spark):
    sql.register(spark)
    rows = spark.createDataFrame(list(enumerate(some_texts())), "id int, t string")
    norm = [text.normalize_text(F.col("t")) if i == 4 else text.normalize_text(F.lit(None).cast("string")) if i else text.normalize_text(F.lit("s")) for i in range(5)]
    want = rows.select("id", text.normalize_text(F.col("t")).alias("n"), text.fold_for_matching(F.col("t")).alias("f"), text.content_hash(text.hash_payload(*norm)).alias("h"))
    got = spark.sql("SELECT id, text_normalize(t) AS n, text_fold(t) AS f, content_fingerprint('s', NULL, NULL, NULL, t) AS h FROM {r}", r=rows)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_number_table(spark):
    sql.register(spark)
    rows = spark.createDataFrame(list(enumerate(some_texts())), "id int, t string")
    got = spark.sql("SELECT id, n.* FROM {r}, LATERAL number_tokens(t) AS n", r=rows)
    want = numbers.extract_numbers(rows, ["id"], "t")
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 100
    assert spark.sql("SELECT * FROM number_tokens('三百多万')").collect()[0].fuzzy


def test_batches_of_sql_functions_are_cut_by_bytes(spark):
    from groundwork import sql

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    sql.register(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) == 6 << 20
