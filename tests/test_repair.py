"""Repair of model outputs: each rule, its limits, and whole outputs with escapes."""

import json
import random

import pytest

from groundwork.operators.repair import balanced_json, repair_outputs, repaired

CLEAN = json.dumps({"title": "a \"quoted\" } title, None", "claims": [{"text": "x\\y\n{", "n": 1.5}], "ok": True}, ensure_ascii=False)

CASES = [
    (CLEAN, CLEAN, ""),
    (f"\n\n  {CLEAN} \n", CLEAN, ""),
    ("﻿" + CLEAN, CLEAN, "stripped_bom"),
    (f"```json\n{CLEAN}\n```", CLEAN, "stripped_code_fence"),
    (f"  ```\n{CLEAN}```  ", CLEAN, "stripped_code_fence"),
    ('{"a": 1,}', '{"a": 1}', "removed_trailing_commas"),
    ('{"a": [1, 2, ],}', '{"a": [1, 2]}', "removed_trailing_commas"),
    ("[1, ,\n]", "[1]", "removed_trailing_commas"),
    ('{"a": True, "b": False, "c": None}', '{"a": true, "b": false, "c": null}', "normalized_python_literals"),
    ('{title: "人口", 论点: [], a-b_1 : 2}', '{"title": "人口", "论点": [], "a-b_1" : 2}', "quoted_bare_keys"),
    ('{"a": 1 "b": 2}', '{"a": 1,"b": 2}', "inserted_missing_commas"),
    ('{"a": {"x": 1} "b": 2}', '{"a": {"x": 1},"b": 2}', "inserted_missing_commas"),
    ('{"a": "x"\n"b": [2] "c": 3}', '{"a": "x","b": [2],"c": 3}', "inserted_missing_commas"),
    ('{"a": "x"' + f'"{"k" * 300}": 1}}', '{"a": "x",' + f'"{"k" * 300}": 1}}', "inserted_missing_commas"),
    (r'{"a": "he said \"b\": fine", "c": 2}', r'{"a": "he said \"b\": fine", "c": 2}', ""),
    ('```json\n{title: "t", claims: [], "b": 1 "c": None,}\n```', '{"title": "t", "claims": [], "b": 1,"c": null}', "stripped_code_fence,quoted_bare_keys,removed_trailing_commas,inserted_missing_commas,normalized_python_literals"),
    ('He asked: "Sure?" I said: ' + CLEAN + " The end {", CLEAN, "extracted_json_object"),
    (f"```json\nHere:\n{CLEAN}\n```", CLEAN, "stripped_code_fence,extracted_json_object"),
    ('first {"a": 1} then {"b": 2}', '{"a": 1}', "extracted_json_object"),
    ('x [{"a": "]"}] y', '[{"a": "]"}]', "extracted_json_object"),
    (r'{k: "a, b: True,} \" {c: None", "d": None}', r'{"k": "a, b: True,} \" {c: None", "d": null}', "quoted_bare_keys,normalized_python_literals"),
]


@pytest.mark.parametrize("raw, payload, done", CASES)
def test_repairs(raw, payload, done):
    assert repaired(raw) == (payload, done, None)
    assert json.loads(payload) is not None


@pytest.mark.parametrize("raw", [None, "", "  \n", "no structure at all", "[1 2]", '{"a": 1, "b":', '{"a": 1', "{'a': 'quoted'}", '{"a": true "b": 1}', '{"a": "x', '{"a": "\\'])
def test_what_stays_broken_tells_only_places(raw):
    payload, _, error = repaired(raw)
    assert payload is None and f"(length {len(raw or '')})" in error and "quoted" not in error


def test_balanced():
    assert balanced_json("nothing") is None and balanced_json("a [1, {2}") is None
    assert balanced_json('{"a": "}", "b": {"c": "\\"}"}} tail') == '{"a": "}", "b": {"c": "\\"}"}}'


def test_any_value_survives_its_wrapping():
    rnd = random.Random(3)

    def value(depth):
        kind = rnd.randrange(7 if depth else 5)
        if kind < 2:
            return "".join(rnd.choice('ab{}[],:"\\\n\t 1é漢True None') for _ in range(rnd.randrange(12)))
        if kind < 5:
            return (rnd.randrange(-99, 99), rnd.random() * 9, rnd.choice((True, False, None)))[kind - 2]
        if kind == 5:
            return [value(depth - 1) for _ in range(rnd.randrange(4))]
        return {f"k{i}": value(depth - 1) for i in range(rnd.randrange(4))}

    for _ in range(400):
        body = {f"key{i}": value(3) for i in range(rnd.randrange(1, 5))}
        text = json.dumps(body, ensure_ascii=False, indent=rnd.choice((None, 2)))
        for wrapped in (text, f"```json\n{text}\n```", f"Well:\n{text}\nBye.", f"{text[:-1]},}}", f"{{odd: 1, {text[1:]}"):
            payload, _, error = repaired(wrapped)
            assert error is None
            assert {k: v for k, v in json.loads(payload).items() if k != "odd"} == body


def test_only_broken_rows_are_repaired(spark):
    df = spark.createDataFrame([(i, raw) for i, (raw, *_) in enumerate(CASES)] + [(99, None)], "id int, raw_output string")
    got = {r.id: (r.payload, r.repairs) for r in repair_outputs(df).collect()}
    assert got == {**{i: (payload, done) for i, (_, payload, done) in enumerate(CASES)}, 99: (None, "")}


def test_answers_are_read_and_repaired_once(spark, tmp_path):
    """What is filtered by its validity and unnested goes through one scan and one Python step, in batches cut by their bytes."""
    from groundwork.operators import analyses, repair

    path = str(tmp_path / "answers")
    spark.createDataFrame([("1", '{"title": "t", "summary": "s", "analysis_type": "fact", "claims": [{"text": "c", "type": "fact", "confidence": 1}, null], "overall_confidence": 1,}')], "content_id string, raw_output string").write.parquet(path)
    answers = spark.read.parquet(path)
    good = analyses.validate(repair.repair_outputs(answers)).filter("size(violations) < 9")
    claims = analyses.unnested(good)["claims"]
    assert [(r.ord, r.text) for r in claims.orderBy("ord").collect()] == [(0, "c"), (1, None)]
    plan = claims._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("FileScan"), plan.count("ArrowEvalPython"), plan.count("MapInPandas")) == (1, 1, 0)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) == 6 << 20
