"""Periodic runs against a search by the definition, and the query against its whole contract in plain Python."""

import hashlib
import random
import re
import zlib

from groundwork.llm.periodic import block_runs, collapsed, periodic_runs
from groundwork.llm.q_periodic import op12_periodic_runs


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i - q] for i in range(q, len(w))))


def plain_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if length >= max(6, 4 * q) and smallest_period(w[start:j]) == q:
                out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_kept(w, runs):
    return [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]


def samples(rng, n):
    for _ in range(n):
        kind = rng.random()
        letters = "ab" if kind < 0.4 else "abc" if kind < 0.7 else "abcdefghijkl"
        w = [rng.choice(letters) for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 4)):
            block = [rng.choice(letters) for _ in range(rng.randrange(1, 12))]
            w += (block * rng.randrange(1, 8))[: rng.randrange(1, 80)]
        yield w


def test_runs_are_those_of_the_definition():
    some = list(samples(random.Random(5), 1500))
    words, runs = block_runs([" ".join(w).encode() for w in some])
    for w, ws, found in zip(some, words, runs):
        assert [x.decode() for x in ws] == w
        assert found == plain_runs(w), w
        assert collapsed(ws, found).decode().split() == plain_kept(w, found)


def test_long_texts_take_linear_steps():
    equal = b"a " * 300_000
    pair = b"a b " * 150_000
    nested = ((b"a " * 20 + b"b ") * 40 + b"c ") * 30
    words, runs = block_runs([equal, pair, nested])
    assert runs[0] == [(0, 300_000, 1)] and runs[1] == [(0, 300_000, 2)]
    assert (0, 30 * (40 * 21 + 1), 841) in runs[2] and (0, 840, 21) in runs[2] and (0, 20, 1) in runs[2]


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a a a a a a", "x"), (3, "a a a a a a", "x"), (None, "b\x0bb b b b b c", "x"), (5, "a a a", "x")]
    got = periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs string")).collect()
    by = {(r.doc_id, r.n_words): r for r in got}
    assert len(got) == 6 and by[1, 0].runs == [] and by[2, 0].collapsed == ""
    assert [tuple(x) for x in by[3, 6].runs] == [(0, 6, 1)] and by[3, 6].collapsed == "a"
    assert by[None, 7].collapsed == "b c" and by[5, 1].collapsed == "a a a"
    assert periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_row(doc_id, text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(plain_kept(w, runs))))


def test_the_query_gives_the_contract(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, " \n".join(w)) for i, w in enumerate(samples(rng, 300))] + [(1000, None), (1001, " \t"), (1002, "eins zwei")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert got == {plain_row(*r) for r in rows}
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 15
