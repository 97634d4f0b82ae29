"""Paths of notes against the sequential rule; written notes."""

import random

import pytest
from pyspark.sql import functions as F

from groundwork.operators import notes
from groundwork.sources import note_files


def sequential_paths(rows, stored):
    """rows (content_id, source, source_id, name, created_at) in order; stored: path to identity, None if foreign."""
    held, out = dict(stored), {}
    for cid, source, sid, name, _ in sorted(rows, key=lambda r: (r[4], r[0])):
        stem, me = f"Notes/Processed/{name}", (source, sid)
        for path in (f"{stem}.md", *(f"{stem}-{cid[:n]}.md" for n in (6, 12, 32))):
            if path not in held or held[path] == me:
                break
        else:
            path = next((p for k in range(2, 100) if (p := f"{stem}-{cid[:6] or 'dup'}-{k}.md") not in held), None)
        out[cid, sid] = path
        if path:
            held.setdefault(path, me)
    return out


def placed(spark, rows, stored):
    made = spark.createDataFrame(rows, "content_id string, source string, source_id string, file_name string, created_at string").withColumn("kind", F.lit("processed")).withColumn("markdown", F.lit("x"))
    index = spark.createDataFrame([(p, *(o or (None, None)), o is None) for p, o in stored.items()], "path string, source string, source_id string, foreign boolean")
    return {(r.content_id, r.source_id): r.path for r in notes.assign_paths(made, index).collect()}


def test_paths_equal_the_sequential_rule(spark):
    rnd = random.Random(2)
    for _ in range(3):
        rows = []
        for i in range(150):
            cid = "".join(rnd.choice("ab") * 6 + rnd.choice("ab") * 6 + rnd.choice("ab") * 20) + (str(i) if rnd.random() < 0.5 else "")
            rows.append((cid + f"{i}", "s", str(i if rnd.random() < 0.9 else 7), rnd.choice("TU"), f"{i:05}"))
        stored = {"Notes/Processed/T.md": None, f"Notes/Processed/U-{'a' * 6}.md": ("s", "7"), f"Notes/Processed/T-{'b' * 6}-3.md": ("s", "x"), f"Notes/Processed/U-{'b' * 6}-2.md": None}
        assert placed(spark, rows, stored) == sequential_paths(rows, stored)


def test_numbers_run_out(spark):
    rows = [(f"{"c" * 40}{i}", "s", str(i), "T", f"{i:05}") for i in range(105)]
    got = placed(spark, rows, {"Notes/Processed/T-cccccc-50.md": None})
    assert got == sequential_paths(rows, {"Notes/Processed/T-cccccc-50.md": None})
    assert sum(p is None for p in got.values()) == 105 - 4 - 97


def test_long_front_matter_values_are_read_whole(spark):
    long = "x" * 1_100_000 + "'s"
    made = notes.render_notes(spark.createDataFrame([("1", "s'", long)], "content_id string, source string, source_id string"))
    row = notes.existing_index(made.select(F.lit("p").alias("path"), "markdown")).collect()[0]
    assert (row.source, row.source_id, row.foreign) == ("s'", long, False)


def files(root):
    return {str(p.relative_to(root)): p.read_bytes().decode() for p in root.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def some_notes(spark, *rows):
    return spark.createDataFrame(rows, "content_id string, path string, markdown string").withColumn("path_error", F.when(F.col("path").isNull(), "MARKDOWN_WRITE_FAILED")).repartition(3)


def test_notes_are_written_by_policy(spark, tmp_path):
    root = tmp_path / "vault"
    first = some_notes(spark, ("1", "Notes/Processed/a ü+%.md", "eins\n"), ("2", "Notes/Failed/b.md", "zwei"), ("3", None, "x"))
    told = lambda df: {r.content_id: (r.path, r.status, r.n_bytes) for r in df.collect()}
    assert told(notes.write_notes(first, str(root))) == {"1": ("Notes/Processed/a ü+%.md", "created", 5), "2": ("Notes/Failed/b.md", "created", 4)}
    assert files(root) == {"Notes/Processed/a ü+%.md": "eins\n", "Notes/Failed/b.md": "zwei"}
    assert {tuple(r) for r in note_files.standing_notes(spark, str(root)).collect()} == set(files(root).items())
    again = some_notes(spark, ("1", "Notes/Processed/a ü+%.md", "new"), ("4", "Notes/c.md", "drei"))
    assert {k: v[1] for k, v in told(notes.write_notes(again, str(root), "keep_existing")).items()} == {"1": "skipped", "4": "created"}
    assert files(root)["Notes/Processed/a ü+%.md"] == "eins\n"
    assert {k: v[1] for k, v in told(notes.write_notes(again, str(root))).items()} == {"1": "updated", "4": "updated"}
    assert files(root) == {"Notes/Processed/a ü+%.md": "new", "Notes/Failed/b.md": "zwei", "Notes/c.md": "drei"}


def test_a_job_that_fails_leaves_nothing_half_written(spark, tmp_path):
    root = tmp_path / "vault"
    notes.write_notes(some_notes(spark, ("1", "Notes/a.md", "old")), str(root))
    rows = [(str(i), f"Notes/{'a' if i == 1 else i}.md", "new") for i in range(60)]
    lost = some_notes(spark, *rows).withColumn("markdown", F.when(F.col("content_id") == "59", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("markdown")))
    with pytest.raises(Exception, match="lost"):
        note_files.write_note_files(lost, str(root))
    for path in ("../x.md", "/x.md", "~/x.md", "a/../../x.md"):
        with pytest.raises(Exception, match="leaves the folder"):
            note_files.write_note_files(some_notes(spark, ("1", path, "x")), str(root))
    assert {p: t for p, t in files(root).items() if not p.startswith(".staged-")} == {"Notes/a.md": "old"}
    assert {r.path for r in note_files.standing_notes(spark, str(root)).collect()} == {"Notes/a.md"}


def test_scalars_are_what_a_yaml_library_writes(spark):
    yaml = pytest.importorskip("yaml")
    rnd = random.Random(5)
    fixed = ["", " ", "a", "y", "Yes", "null", "~", "=", "<<", "-", "- a", "-a", "?", "? a", "?a", ":", ":a", "a:", "a: b", "a:b", "a #b", "a#b", "#a", "'", "it's", '"q"', "1", "1.5", "1_0", "0x1F", "012", "09", "1:30", "1e3", "1.0e+3", ".5", "-.inf", ".nan", "2024-01-01", "2024-1-1 1:00:00", "2024-01-01T00:00:00Z", "---", "--- a", "...", "a, b [c]", "[a", "{a", "%a", "@a", "`a", "*a", "&a", "!a", "|", ">", "a ", " a", "中文：题", "ä,é", "\U0001f600 x", "中 #x", "0o7", "0b1", "+1", "1__0.", "1:2.5"]
    texts = fixed + ["".join(rnd.choice("ab:#-?,[]{}'\"%@ .0159_yné中!&*|>=~<") for _ in range(rnd.randint(1, 7))) for _ in range(1500)]
    odd = ["a\nb", "a\tb", "\x00", "a\x85b", "x y ", "﻿z", "\x7f\x9f", 'q"\\\r\n']
    rows = spark.createDataFrame(list(enumerate(texts + odd)), "i int, x string").select("i", notes.scalar(F.col("x")).alias("y"))
    got = {r.i: r.y for r in rows.collect()}
    for i, x in enumerate(texts):
        assert f"k: {got[i]}\n" == yaml.safe_dump({"k": x}, allow_unicode=True, width=10_000), x
    for i, x in enumerate(odd, len(texts)):
        assert "\n" not in got[i] and yaml.safe_load(f"k: {got[i]}\n") == {"k": x}


def test_front_matter_is_read_back(spark):
    names = ["a: b", "it's", 'q"\\', "x\ny ", "1", "﻿", "- a", "'a'"]
    made = notes.render_notes(spark.createDataFrame([(str(i), x, x) for i, x in enumerate(names)], "content_id string, source string, source_id string"))
    back = {r.path: (r.source, r.source_id, r.foreign) for r in notes.existing_index(made.select(F.col("content_id").alias("path"), "markdown")).collect()}
    assert back == {str(i): (x, x, False) for i, x in enumerate(names)}
