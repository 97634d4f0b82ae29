"""Functions over text, URLs and names, duplicates, tables, entities, grounding, repair, notes, runs and streams, on golden rows."""

import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from groundwork.functions import names, redact, text, urls
from groundwork.operators import analyses, chunks, dedup, entities, grounding, jobs, notes, numbers, redirects, repair, warehouse
from groundwork.sources import assets, pages, raw
from groundwork.streaming import incremental


def apply(spark, fn, values, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i long, x {kind}")
    return [r.y for r in rows.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalize(spark):
    given = [None, "", "  a\t\n b ", "ＡＢＣ　１", "a​b﻿", "a\x0bb\x0cc\x00", "ﬁ é", "　x　"]
    assert apply(spark, text.normalize_text, given) == ["", "", "a b", "ABC 1", "ab", "abc", "fi é", "x"]
    assert apply(spark, text.fold_for_matching, ["Straße", "ＡI", None, "A b"]) == ["strasse", "ai", "", "a b"]


def test_source_ids(spark):
    rows = spark.createDataFrame([("s", x, "t") for x in ("1", " ", None, "HTTPS://a", "www.a", "wwwa")], "source string, source_id string, raw_text string")
    got = [(r.source_id, r.needs_manual_review) for r in dedup.fingerprinted(rows).collect()]
    assert [g[0][:5] for g in got] == ["1", "hash:", "hash:", "hash:", "hash:", "wwwa"] and [g[1] for g in got] == [False, True, True, True, True, False]


def sequential_clean(x):
    x = (x or "").replace("\r\n", "\n").replace("\r", "\n")
    kept, before, blanks = [], None, 0
    for line in x.split("\n"):
        bare = line.strip()
        if not bare:
            blanks, before = blanks + 1, None
            if blanks <= 2:
                kept.append("")
        elif bare == before:
            blanks = 0
        else:
            blanks, before = 0, bare
            kept.append(line)
    return "\n".join(kept).strip("\n")


def test_cleaning_equals_the_sequential_rule(spark):
    rnd = random.Random(1)
    given = ["".join(rnd.choice(["a", "b", " ", "\n", "\n", "\r\n", "　"]) for _ in range(rnd.randrange(30))) for _ in range(400)] + [None, ""]
    assert apply(spark, lambda x: text.clean_source_text(x)["text"], given) == [sequential_clean(x) for x in given]


def sequential_sentences(x):
    out, now, i = [], "", 0
    while i < len(x):
        now += x[i]
        if x[i] in "。！？!?":
            while i + 1 < len(x) and x[i + 1] in "。！？!?":
                i += 1
                now += x[i]
        if x[i] in "\n。！？!?" or x[i] == "." and not (i + 1 < len(x) and x[i + 1].isdecimal()):
            out.append(now)
            now = ""
        i += 1
    return out + ([now] if now else [])


def sequential_chunks(x, most, overlap):
    parts = []
    for s in (s.strip() for s in sequential_sentences(x)):
        parts += [s[i : i + most] for i in range(0, len(s), most)]
    done, now = [], []
    for p in parts:
        if now and sum(map(len, now)) + len(p) > most:
            done.append(now)
            now = now[-overlap:] if overlap else []
            while now and sum(map(len, now)) + len(p) > most:
                now = now[1:]
        now = [*now, p]
    return ["".join(c) for c in done + ([now] if now else [])]


def test_sentences_and_chunks(spark):
    rnd = random.Random(2)
    given = ["".join(rnd.choice(["a", "bc", "d ", ".", "3.14", "。", "！？", "\n", "x" * 9]) for _ in range(rnd.randrange(25))) for _ in range(250)]
    assert apply(spark, text.split_sentences, given) == [sequential_sentences(x) for x in given]
    for overlap in (0, 1, 3):
        assert apply(spark, lambda x, o=overlap: chunks.chunks(x, 12, o), given) == [sequential_chunks(x, 12, overlap) for x in given]


def test_numbers():
    value = lambda s: [(t[1], t[2], t[3], t[4]) for t in numbers.number_tokens(s)]
    assert value("一千六百万多") == [(Decimal(16000000), "plain", 10**4, True)]
    assert value("3.5万 和 50%") == [(Decimal(50), "percent", 1, False), (Decimal("35000.0"), "plain", 10**4, False)]
    assert value("百分之二十") == [(Decimal(20), "percent", 1, False)]
    assert value("十") == [] and value("二〇二四")[0][0] == 4 and value("１２")[0][0] == 12


def test_number_grounding(spark):
    row = lambda key, v, kind, fuzzy: (key, 0, 0, str(v), Decimal(v), kind, fuzzy)
    schema = "content_id long, claim_ord int, ord int, raw string, value decimal(38,10), kind string, fuzzy boolean"
    claims = spark.createDataFrame([row(1, 100, "plain", True), row(2, 100, "plain", False), row(3, 0, "plain", True), row(4, 50, "percent", False)], schema)
    sources = spark.createDataFrame([row(1, 115, "plain", False), row(2, 101, "plain", False), row(3, 1, "plain", True), row(4, 50, "plain", False)], schema)
    assert {r.content_id for r in numbers.ungrounded(claims, sources, "content_id", ["claim_ord"]).collect()} == {2, 3, 4}


def test_rules(spark):
    kind = "content_id long, ord int, text string, type string, evidence array<struct<type:string,description:string>>"
    claims = spark.createDataFrame([(1, 0, "Apple sold 500 phones", "fact", [("source", "x")]), (1, 1, "nothing", "fact", [("quote", " ")]), (1, 2, "apple", "fact", []), (1, 3, "BANANA", "fact", [("none", "n"), ("data", "d")])], kind)
    sources = spark.createDataFrame([(1, "APPLE sold 400 phones")], "content_id long, text string")
    ents = spark.createDataFrame([(1, 0, "Apple"), (1, 1, "Fruit")], "content_id long, ord int, name string")
    got = {r.ord: r for r in grounding.ground(claims, sources, ents, spark.createDataFrame([("Fruit", "banana")], "canonical string, alias string")).collect()}
    assert [got[i].rules for i in range(4)] == [["R2.2"], ["R2.3"], ["R1"], ["R2.1"]]
    assert got[0].path == "structured" and got[1].path == "semantic" and "500" in got[0].detail and got[3].ungrounded_entities == ["Fruit"]


def sequential_dedup(rows):
    kept, out = [], {}
    for seq, source, sid, h, says in rows:
        same = [k for k in kept if k[1] == source and k[2] == sid] or [k for k in kept if says and k[4] and k[1] == source and k[3] == h]
        if same:
            out[seq] = (False, same[0][0])
        else:
            kept.append((seq, source, sid, h, says))
            out[seq] = (True, None)
    return out


def test_batch_dedup_equals_the_sequential_process(spark):
    rnd = random.Random(3)
    for _ in range(6):
        rows = [(i, rnd.choice("ab"), rnd.choice("12345"), rnd.choice("xyzuvw"), rnd.random() < 0.8) for i in range(25)]
        df = spark.createDataFrame(rows, "seq long, source string, source_id string, content_hash string, discriminating boolean").withColumn("content_hash_version", F.lit(2))
        assert {r.seq: (r.kept, r.duplicate_of) for r in dedup.within_batch(df).collect()} == sequential_dedup(rows)


def test_urls(spark):
    given = ["https://www.bilibili.com/a?b#c", "ftp://x.com/a", "x.com", "", "https://", "https://user@x.com:8/p", "http://evilx.com", "file:///etc"]
    assert apply(spark, urls.url_verdict, given) == [None, "UNSUPPORTED_URL_SCHEME", "INVALID_URL", "INVALID_URL", "INVALID_URL", None, "DOMAIN_NOT_ALLOWED", "UNSUPPORTED_URL_SCHEME"]
    assert apply(spark, urls.normalized_url, ["https://user@X.com:8/p?q=1#f"]) == ["https://x.com/p?q=1"]
    assert apply(spark, urls.first_url, ["看 https://v.x.com/ab/复制", "(https://a.b).", "none"]) == ["https://v.x.com/ab/", "https://a.b", None]


def test_redirect_loops_end(spark):
    hops = spark.createDataFrame([("https://x.com/a", 302, "/b"), ("https://x.com/b", 302, "a"), ("https://x.com/c", 301, "https://x.com/d"), ("https://x.com/d", 200, None)], "url string, status_code int, location string")
    starts = spark.createDataFrame([(1, "https://x.com/a"), (2, "https://x.com/c"), (3, "https://x.com/none"), (4, "nope")], "id long, url string")
    got = {r.id: (r.final_url, r.hops, r.error_type) for r in redirects.resolve_redirects(starts, hops).collect()}
    assert got == {1: (None, 5, "SHORT_LINK_RESOLUTION_FAILED"), 2: ("https://x.com/d", 1, None), 3: (None, 0, "SHORT_LINK_RESOLUTION_FAILED"), 4: (None, 0, "INVALID_URL")}


def test_names(spark):
    given = [" a/b: c ", None, "con.txt", "..x..", "标题：副", "a" * 100, "​"]
    rows = apply(spark, lambda x: names.file_name(x, F.lit("id-1234567")), given)
    assert rows == ["ab c", "id-12345", "_con.txt", "x", "标题：副", "a" * 80, "id-12345"]
    assert apply(spark, names.path_inside, ["a/b", "../a", "a/../../b", "/a", "~a", "a/../b"]) == [True, False, False, False, False, True]
    assert apply(spark, names.fenced, ["x ````y` "]) == ["`````text\nx ````y`\n`````"]


def test_redaction(spark):
    given = ["token = abcd1234", "Authorization: Bearer abcdefgh12", "sk-abcdefghij", "api_key: bearer x", "password=abc"]
    m = redact.MASK
    assert apply(spark, redact.scrub, given) == [f"token = {m}", f"Authorization: Bearer {m}", m, "api_key: bearer x", "password=abc"]
    df = spark.createDataFrame([("t", "x" * 300, {"password": "p", "note": "token=abcd"})], "api_token string, raw_text string, data map<string,string>")
    r = redact.mask_columns(df, show_content=True).first()
    assert r.api_token == m and r.raw_text.endswith("<truncated 100 chars>") and r.data == {"password": m, "note": f"token={m}"}
    assert redact.mask_columns(df).first().raw_text == redact.CONTENT_MASK


def test_repair():
    cases = {
        '{"a":1}': ('{"a":1}', ""), '```json\n{"a": [1,2,]}\n```': ('{"a": [1,2]}', "stripped_code_fence,removed_trailing_commas"),
        'sure: {a: True, "b": "x}y, c: None"} bye': ('{"a": true, "b": "x}y, c: None"}', "extracted_json_object,quoted_bare_keys,normalized_python_literals"),
        '{"a": "q" "b": None}': ('{"a": "q","b": null}', "inserted_missing_commas,normalized_python_literals"), 'hi "odd {"k": "v"} t': ('{"k": "v"}', "extracted_json_object"),
    }
    for given, (payload, done) in cases.items():
        assert repair.repaired(given) == (payload, done, None)
    payload, _, error = repair.repaired('{"secret" 1}')
    assert payload is None and "secret" not in error and repair.repaired(None)[2]


def test_strict_source(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"source":"a","source_id":"1","source_url":"","media_type":"text"}\n{"source":" ","source_id":"1","source_url":"","media_type":"film","x":1}\nbroken\n')
    good, bad = raw.read_json_lines(spark, str(tmp_path / "in.json"))
    assert good.count() == 1 and sorted(r.reason for r in bad.collect()) == ["blank:source;enum:media_type;unknown:x", "not an object"]


def test_assets(spark):
    heads = [b"\xff\xd8\xff0", b"RIFF0000WAVE", b"RIFF0000WEBP", b"RIFF0000XXXX", b"\0\0\0\x18ftypM4A ", b"\0\0\0\x18ftypisom", b"ID3", b"", b"<html>"]
    assert apply(spark, assets.sniffed, [bytearray(h) for h in heads], "binary") == ["image/jpeg", "audio/wav", "image/webp", None, "audio/mp4", "video/mp4", "audio/mpeg", None, None]


def test_pages(spark):
    rows = [("1", "u", '{"status_code":0,"aweme_detail":{"aweme_id":"1","desc":"a  b","author":{"uid":"9"},"images":[{}]}}', ""), ("2", "u", None, '<script id="RENDER_DATA" type="x">%7B%22a%22%3A%5B%7B%22aweme_id%22%3A%222%22%2C%22desc%22%3A%22d%22%7D%5D%7D</script>'), ("3", "u", "{}", "请先登录"), ("4", "u", None, None)]
    got = {r.aweme_id: r for r in pages.from_pages(spark.createDataFrame(rows, "aweme_id string, url string, detail_json string, html string")).collect()}
    assert (got["1"].title, got["1"].media_type, got["1"].author_id) == ("a b", "image", "9") and got["2"].raw_text == "d"
    assert got["3"].miss_reason == "COOKIE_REQUIRED" and got["4"].miss_reason == "CONTENT_NOT_FOUND"


def test_warehouse_versions(spark, tmp_path):
    store = warehouse.Warehouse(spark, str(tmp_path))
    assert store.read("topics").isEmpty()
    store.write("topics", spark.createDataFrame([("1", "a")], "id string, name string"))
    store.write("topics", store.read("topics").unionByName(spark.createDataFrame([("2", "b")], "id string, name string")))
    assert store.read("topics").count() == 2
    with pytest.raises(ValueError):
        store.write("topics", spark.createDataFrame([("1", "a"), ("2", "a")], "id string, name string"))
    assert store.read("topics").count() == 2
    store.append("topics", spark.createDataFrame([("3", "c")], "id string, name string"))
    store.append("topics", spark.createDataFrame([], "id string, name string"))
    for again in ([("4", "c")], [("4", "d"), ("5", "d")]):
        with pytest.raises(ValueError):
            store.append("topics", spark.createDataFrame(again, "id string, name string"))
    assert sorted(r.name for r in store.read("topics").collect()) == ["a", "b", "c"]
    store.write("topics", store.read("topics").filter("name <> 'a'"))
    store.append("topics", spark.createDataFrame([("6", "a")], "id string, name string"))
    assert sorted((r.id, r.name) for r in store.read("topics").collect()) == [("2", "b"), ("3", "c"), ("6", "a")]


def test_merges(spark):
    e = spark.createDataFrame([(x, x.upper(), "other", None) for x in "abcd"], "id string, canonical_name string, entity_type string, description string")
    a = spark.createDataFrame([("1", "a", "al"), ("2", "b", "bl")], "id string, entity_id string, alias string")
    links = spark.createDataFrame([("x", "a", 0.5), ("x", "b", None), ("y", "a", 0.1)], "content_id string, entity_id string, confidence double")
    ask = spark.createDataFrame([(1, "a", "b", True, False), (2, "b", "c", True, False), (3, "d", "d", True, False), (4, "a", "c", True, False)], "seq long, source_id string, target_id string, delete_source boolean, dry_run boolean")
    ents, als, lks = entities.apply_merges(ask, e, a, links)
    assert {r.id for r in ents.collect()} == {"c", "d"}
    assert {(r.entity_id, r.alias) for r in als.collect()} == {("c", x) for x in ("A", "B", "al", "bl")}
    assert {(r.content_id, r.entity_id) for r in lks.collect()} == {("x", "c"), ("y", "c")}
    plan = {r.seq: r for r in entities.merge_plan(ask, e, a, links).collect()}
    assert plan[3].error == "SELF" and (plan[1].links_to_move, plan[1].links_to_drop) == (1, 1) and plan[1].to_move == ["A", "al"]


def sequential_merges(asks, names, owner, links):
    for _, s, t, delete, dry in asks:
        if dry or s == t or s not in names or t not in names:
            continue
        forms = {names[s]} | {f for f, o in owner.items() if o == s}
        clash = {f for f in forms if f != names[t] and owner.get(f) not in (None, s, t)}
        for f in forms - clash:
            if owner.get(f) == s:
                del owner[f]
            if f != names[t]:
                owner.setdefault(f, t)
        for c, e in [k for k in links if k[1] == s]:
            confidence = links.pop((c, e))
            links.setdefault((c, t), confidence)
        if delete and not clash:
            del names[s]
    return names, owner, links


def test_merges_equal_the_sequential_process(spark):
    rnd = random.Random(11)
    ids = [f"e{i}" for i in range(40)]
    names = {i: i.upper() for i in ids}
    owner = {f: rnd.choice(ids) for f in [*(f"al{i}" for i in range(40)), *(names[i] for i in rnd.sample(ids, 12))]}
    links = {(f"c{rnd.randrange(9)}", rnd.choice(ids)): n / 100 for n in range(90)}
    # Many sources for two targets, which are sources themselves near the end.
    asks = [(n, rnd.choice(ids), rnd.choice(["e0", "e1", *ids[:6]]), rnd.random() < 0.8, rnd.random() < 0.1) for n in range(24)] + [(24, "e0", "e1", True, False), (25, "e7", "e0", True, False)]
    e = spark.createDataFrame([(i, n, "other", None) for i, n in names.items()], "id string, canonical_name string, entity_type string, description string")
    a = spark.createDataFrame([(str(n), o, f) for n, (f, o) in enumerate(owner.items())], "id string, entity_id string, alias string")
    l = spark.createDataFrame([(*k, v) for k, v in links.items()], "content_id string, entity_id string, confidence double")
    got = entities.apply_merges(spark.createDataFrame(asks, "seq long, source_id string, target_id string, delete_source boolean, dry_run boolean"), e, a, l)
    left, owned, linked = sequential_merges(asks, names, owner, links)
    assert {r.id: r.canonical_name for r in got[0].collect()} == left
    assert sorted((r.alias, r.entity_id) for r in got[1].collect()) == sorted(owned.items())
    assert {(r.content_id, r.entity_id): r.confidence for r in got[2].collect()} == linked


def test_many_sources_merge_in_one_round(spark, monkeypatch):
    rounds, plan = [], entities.merge_plan
    monkeypatch.setattr(entities, "merge_plan", lambda *a: rounds.append(1) or plan(*a))
    e = spark.range(200).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("n"), F.col("id")).alias("canonical_name"), F.lit("other").alias("entity_type"), F.lit(None).cast("string").alias("description"))
    ask = spark.range(1, 200).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("source_id"), F.lit("0").alias("target_id"), F.lit(True).alias("delete_source"), F.lit(False).alias("dry_run"))
    got = entities.apply_merges(ask, e, spark.createDataFrame([], "id string, entity_id string, alias string"), spark.createDataFrame([], "content_id string, entity_id string, confidence double"))
    assert len(rounds) == 1 and got[0].count() == 1 and got[1].count() == 199


def test_contract(spark):
    good = '{"title":"t","summary":"s","analysis_type":"fact","claims":[{"text":"c","type":"fact","confidence":"0.5","evidence":[]}],"overall_confidence":1}'
    bad = '{"title":"t","analysis_type":"x","claims":[{"text":" ","type":"fact","confidence":2}],"overall_confidence":"1.5","facts":[]}'
    got = apply(spark, analyses.violations, [good, bad, "[1]"])
    assert got[0] == [] and got[1] == ["missing:summary", "forbidden:facts", "enum:analysis_type", "range:overall_confidence", "blank:claims.text", "range:claims.confidence"] and got[2] == ["type:object"]


def test_note_paths(spark):
    rows = spark.createDataFrame([("c1-aaaaaaaa", "s", "1", "T", "1"), ("c2-bbbbbbbb", "s", "2", "T", "2"), ("c3-cccccccc", "s", "3", "T", "3")], "content_id string, source string, source_id string, title string, created_at string")
    rendered = notes.render_notes(rows)
    existing = spark.createDataFrame([("Notes/Processed/T.md", "s", "2", False)], "path string, source string, source_id string, foreign boolean")
    got = {r.content_id: r.path for r in notes.assign_paths(rendered, existing).collect()}
    assert got == {"c1-aaaaaaaa": "Notes/Processed/T-c1aaaa.md", "c2-bbbbbbbb": "Notes/Processed/T.md", "c3-cccccccc": "Notes/Processed/T-c3cccc.md"}
    index = notes.existing_index(rendered.select(F.col("content_id").alias("path"), "markdown")).collect()
    assert {(r.source, r.source_id, r.foreign) for r in index} == {("s", "1", False), ("s", "2", False), ("s", "3", False)}


def answers(spark):
    body = '{"title":"T","summary":"s","analysis_type":"fact","claims":[{"text":"apple 500","type":"fact","confidence":0.9,"evidence":[{"type":"source","description":"d"}]}],"topics":["x"],"entities":[{"name":"apple","type":"company"}],"overall_confidence":0.5}'

    def model(prompts):
        ok = F.contains("prompt", F.lit("apple")) | (F.col("phase") == "synthesis")
        return prompts.select("content_id", "phase", "prompt_id", "part", "attempt", F.when(ok, F.lit(body)).otherwise("bad").alias("raw_output"), F.lit(None).cast("string").alias("error_type"))

    return model


def test_whole_run_and_again(spark, tmp_path):
    tables = {t: spark.createDataFrame([], s) for t, s in warehouse.SCHEMAS.items()}
    rows = [(1, "s", "1", "A", "apple 500"), (2, "s", "2", "A", "apple 500"), (3, "s", "3", "B", "pear"), (4, "s", "4", None, " "), (5, "s", "5", "C", "apple. " * 40)]
    batch = spark.createDataFrame(rows, "seq long, source string, source_id string, title string, raw_text string")
    as_of = F.lit("2024-01-01 00:00:00").cast("timestamp")
    out = jobs.run(batch, tables, answers(spark), as_of, total=200, vault=str(tmp_path / "vault"))
    got = {r.seq: (r.outcome, r.error_type) for r in out["outcomes"].collect()}
    assert got == {1: ("completed", None), 2: ("duplicate", None), 3: ("failed", "LLM_INVALID_OUTPUT"), 4: ("failed", "EMPTY_SOURCE_TEXT"), 5: ("completed", None)}
    assert {r.kind for r in out["notes"].collect()} == {"processed", "failed"} and out["steps"].filter("seq = 1").count() == 13
    log = {(r.seq, r.step): (r.status, r.error_type) for r in out["steps"].collect()}
    last = {seq: max(jobs.STEPS.index(step) for s, step in log if s == seq) for seq in range(1, 6)}
    assert {seq: jobs.STEPS[n] for seq, n in last.items()} == {1: "complete", 2: "deduplicate", 3: "analyze", 4: "prepare_text", 5: "complete"}
    assert {k: v for k, v in log.items() if v[0] != "ok"} == {(3, "analyze"): ("failed", "LLM_INVALID_OUTPUT"), (4, "prepare_text"): ("failed", "EMPTY_SOURCE_TEXT")}
    assert {r.phase for r in out["attempts"].collect()} == {"analysis", "synthesis"}
    files = {str(p.relative_to(tmp_path / "vault")): p.read_text() for p in (tmp_path / "vault").rglob("*.md")}
    assert files == {r.path: r.markdown for r in out["notes"].collect()} and len(files) == 4
    stages = {r.stage: r for r in out["stages"].collect()}
    assert (stages["deduplicate"].rows, stages["analyze"].rows, stages["analyze"].errors, stages["write_obsidian"].rows) == (4, 4, 2, 4)
    assert all(r.seconds > 0 for r in stages.values())
    timed = {r.step: r.elapsed for r in out["steps"].filter("seq = 1").collect()}
    assert timed["analyze"] == stages["analyze"].seconds and timed["write_obsidian"] > 0 and timed["preflight"] is None
    report = {r.seq: json.loads(r.report) for r in jobs.run_report(out["steps"]).collect()}
    assert [x["step"] for x in report[2]] == ["preflight", "normalize", "deduplicate"] and report[3][-1]["error_type"] == "LLM_INVALID_OUTPUT"
    later = {k: spark.createDataFrame(out[k].collect(), warehouse.SCHEMAS[k]) for k in warehouse.SCHEMAS}
    again = jobs.run(batch, later, answers(spark), F.lit("2024-01-02 00:00:00").cast("timestamp"), total=200)
    got = {r.seq: r.outcome for r in again["outcomes"].collect()}
    assert got == {1: "duplicate", 2: "duplicate", 3: "failed", 4: "failed", 5: "duplicate"}
    unwritten = jobs.run(batch.filter("seq = 1"), tables, answers(spark), as_of, total=200)  # no vault
    assert {r.step for r in unwritten["steps"].filter("status = 'skipped'").collect()} == {"write_obsidian"}
    kept = jobs.run(batch.filter("seq = 1"), tables, answers(spark), as_of, total=200, vault=str(tmp_path / "vault"), policy="keep_existing")
    assert {(r.step, r.status) for r in kept["steps"].collect() if r.status != "ok"} == {("write_obsidian", "skipped")}


def test_streams(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(k, s, f"2024-01-01 00:{m:02d}:00") for k, s, m in (("a", "processing", 0), ("b", "processing", 1), ("a", "completed", 2), ("c", "x", 40), ("c", "x", 41))]
    spark.createDataFrame(rows, "key string, status string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    schema = "key string, status string, ts timestamp"
    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def collect(stream, name):
        q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert {r.key for r in collect(incremental.first_seen(read(), ["key"], "ts"), "seen")} == {"a", "b", "c"}
    assert [r.key for r in collect(incremental.stuck_work(read()), "stuck")] == ["b"]
    store = warehouse.Warehouse(spark, str(tmp_path / "store"))
    content = read().select(F.lit("s").alias("source"), F.col("key").alias("source_id"), F.col("status").alias("raw_text"), F.unix_seconds("ts").alias("seq"))
    chunked = []
    for n in (1, 2):
        incremental.ingest(content, store, F.lit("2024-01-01").cast("timestamp"), lambda c, _: chunked.extend(r.chunk for r in c.collect())).option("checkpointLocation", str(tmp_path / f"ingest{n}")).trigger(availableNow=True).start().awaitTermination()
        assert sorted(r.source_id for r in store.read("contents").collect()) == ["a", "c"]  # b says what a said before
        assert sorted(chunked) == ["processing", "x"]  # the second time nothing is new


def test_entry_and_oracles(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["doc_id", "outcome", "duplicate_of", "deduplicated_by"]


def test_model_outputs_hold_whole_texts(spark, tmp_path):
    from groundwork.plans import runs, text

    said = 'A "quote", a \\ backslash,\n## a line\tand \x01 "fact", "claims" ' + "long " * 400 + "end"
    rows = [(i, "web", "en", said + str(i)) for i in range(16)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    d = str(tmp_path)
    got = {r.content_id: r.text for r in runs.g3_unnest_whole(spark, d).collect()}
    assert got == {str(i): said + str(i) for i in range(16) if i % 8 not in (5, 6)}
    assert all(said[-3:] in r.raw_output for r in runs._outputs(spark, d).collect() if int(r.content_id) % 8 != 6)
    assert {r.repair: r.n for r in runs.k6_repair(spark, d).collect()} == {"clean": 6, "stripped_code_fence": 2, "extracted_json_object": 2, "inserted_missing_commas": 2, "removed_trailing_commas": 2, "failed": 2}
    assert all(r.markdown.count(f"end{r.content_id}\n") == 2 for r in runs._notes(spark, d).collect())  # as summary and as text
    assert text.p13_budget_whole(spark, d).filter("total_truncated").count() == 16


def test_sentences_end_where_the_rule_says(spark):
    import random
    import re

    from groundwork.functions import text

    rnd = random.Random(8)
    texts = ["".join(rnd.choice("ab \n\r.!?。！？1٣") for _ in range(rnd.randrange(40))) for _ in range(400)] + [""]
    rule = re.compile(r"(?s)[^。！？!?\n.]*(?:\.(?=\d)[^。！？!?\n.]*)*(?:\n|[。！？!?]+|\.(?!\d)|$)")
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", text.split_sentences(F.col("x")).alias("got")).collect()
    assert all(r.got == [s for s in rule.findall(r.x) if s] for r in rows)


def test_normalising_looks_at_no_character_in_a_pattern_first(spark):
    from groundwork.functions import text

    rows = spark.createDataFrame([("ＡＢ",), ("é",), ("plain",), (None,)], "x string").select(text.nfkc(F.col("x")).alias("y"))
    assert [r.y for r in rows.collect()] == ["AB", "é", "plain", None]
    assert "RLIKE" not in rows._jdf.queryExecution().optimizedPlan().toString()
