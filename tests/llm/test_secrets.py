"""Learned formats: the sample under skew, what is scored, and what is left beside a fixed pattern."""

import random

from groundwork.llm import secrets


def test_one_value_in_most_rows_counts_once(spark):
    rnd = random.Random(1)
    make = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(40))
    rows = ["token=" + "a1" * 20] * 9000 + [f"token={make()}" for _ in range(900)] + ["token=" + "z9" * 5000, None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    values = secrets.labelled_credentials(df)
    assert values.filter("kind = 'assign'").count() == 9900  # the very long one is no part of the sample
    formats = secrets.infer_formats(df, sample_size=100)
    assert set(formats) == {"assign", "hex"} and formats["assign"].least == 16 and formats["assign"].digit
    spans = {r.doc_id: r.spans for r in secrets.scan_secrets(df, formats).collect()}
    assert [s.kind for s in spans[9900]] == ["assign"] and spans[9901] == [] and spans[9902] == []


def test_the_sample_is_the_values_with_the_smallest_hashes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, f"password: v{i:08d}") for i in range(3000)], "doc_id long, text string")
    want = {r.v for r in df.select(F.substring("text", 11, 100).alias("v")).orderBy(F.pmod(F.xxhash64("v"), F.lit(1 << 30)), "v").limit(50).collect()}
    seen = []
    real = secrets.Automaton
    secrets.Automaton = lambda values: seen.append(set(values)) or real(values)
    try:
        secrets.infer_formats(df, sample_size=50)
    finally:
        secrets.Automaton = real
    assert seen == [want]


def test_short_formats_and_formats_without_digits_are_scored():
    rnd = random.Random(2)
    make = lambda n, chars: "".join(rnd.choice(chars) for _ in range(n))
    short = secrets.SecretScanner({"assign": secrets.Automaton([make(10, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(300)])}, 0.35)
    found = [s["kind"] for s in short.scan("see Q7ZK2M9XW4 and the words")]
    assert found == ["format"] and short.scan("internationalisation of everything, photographed") == []
    upper = secrets.SecretScanner({"assign": secrets.Automaton([make(24, "ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(300)])}, 0.35)
    assert [s["kind"] for s in upper.scan("x QWJKZVBXPLMQRTYHGNWSXCDE y")] == ["format"]


def test_what_is_left_beside_a_fixed_span_is_scored():
    rnd = random.Random(4)
    make = lambda n: "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    scanner = secrets.SecretScanner({"access": secrets.Automaton([make(20) for _ in range(300)])}, 0.35)
    left, right, run = make(19) + "Z", "Z" + make(19), "0123456789abcdef" * 2
    text = f"a {left}{run}{right} b"
    spans = [(s["kind"], s["first"], s["end"]) for s in scanner.scan(text)]
    assert spans == [("format", 2, 22), ("hex", 22, 54), ("format", 54, 74)]
    many = " ".join(f"{make(19)}Z{run}" for _ in range(5000))  # many of both kinds: no search over all spans
    assert len(scanner.scan(many)) == 10_000


def formats_of(rnd):
    """Three formats and how to make a value of each; the last one's lengths vary."""
    pick = lambda n, chars: "".join(rnd.choice(chars) for _ in range(n))
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    return (
        lambda: f"pk-{pick(4, digits)}-{pick(12, upper)}",
        lambda: f"gh_{pick(36, upper + lower + digits)}",
        lambda: f"{pick(3, upper)}.{pick(6, digits)}.{pick(rnd.randrange(20, 40), upper + digits)}",
    )


def decoys(rnd, n):
    """Clean identifiers: UUIDs, hashes of other lengths, numbers, versions, dates, long words, paths."""
    pick = lambda n, chars: "".join(rnd.choice(chars) for _ in range(n))
    h = "0123456789abcdef"
    kinds = (
        lambda: "-".join(pick(k, h) for k in (8, 4, 4, 4, 12)),
        lambda: pick(20, "0123456789"), lambda: pick(16, h), lambda: pick(28, h),
        lambda: f"{rnd.randrange(9)}.{rnd.randrange(20)}.{rnd.randrange(1000)}-rc{rnd.randrange(9)}+build{rnd.randrange(10**6)}",
        lambda: f"2024-{rnd.randrange(10, 13)}-{rnd.randrange(10, 28)}T10-{rnd.randrange(10, 60)}-00",
        lambda: pick(rnd.randrange(9, 30), "abcdefghijklmnopqrstuvwxyz"),
        lambda: f"src/{pick(8, 'abcdefgh')}/{pick(6, 'stuvw')}_{rnd.randrange(100)}.py",
    )
    return [kinds[i % len(kinds)]() for i in range(n)]


def test_planted_formats_are_learned_and_clean_identifiers_stay(spark):
    rnd = random.Random(6)
    makes = formats_of(rnd)
    rows = [f"some text, token = {makes[i % 3]()} and more" for i in range(360)]
    planted = [makes[i % 3]() for i in range(300)]
    clean = decoys(rnd, 800)
    rows += [f"plain {x} here" for x in planted + clean] + [f"conf={makes[0]()};" for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    spans = {r.doc_id: [(s.kind, s.first, s.end) for s in r.spans] for r in secrets.scan_secrets(df).collect()}
    found = [spans[360 + i] == [("format", 6, 6 + len(x))] for i, x in enumerate(planted)]
    wrong = [x for i, x in enumerate(clean) if any(k == "format" for k, *_ in spans[660 + i])]
    assert sum(found) >= 0.97 * len(planted) and len(wrong) <= 0.01 * len(clean), (sum(found), wrong[:5])
    assert sum([s[0] for s in spans[1460 + i]] == ["format"] for i in range(20)) >= 19
    redacted = {r.doc_id: r.text for r in secrets.redact_secrets(df).collect()}
    assert redacted[660] == rows[660] and redacted[0] == "some text, [SECRET] and more"


def test_order_and_length_are_learned():
    rnd = random.Random(8)
    make = formats_of(rnd)[0]
    a = secrets.Automaton([make() for _ in range(200)])
    classes = secrets._classes
    assert len(a.states) >= 15  # a place of the format each, but for runs that nothing tells apart
    good = make()
    assert a.score(classes(good)) >= a.floor
    shuffled = ["".join(rnd.sample(good, len(good))) for _ in range(50)]
    assert all(a.score(classes(x)) is None for x in (good + "A", good[:-1], good[::-1], good.lower(), *shuffled))


def test_a_repeated_part_of_any_length_is_a_loop():
    rnd = random.Random(9)
    values = ["k_" + "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(8 + int(rnd.expovariate(0.1)))) for _ in range(400)]
    a = secrets.Automaton(values)
    assert len(a.states) < 40 < max(map(len, values))
    assert a.score(secrets._classes("k_" + "QWZ" * 30)) is not None


def test_the_documents_own_format_has_states(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    formats = secrets.infer_formats(docs)
    assert all(len(a.states) > 30 for a in formats.values())  # 40 hex digits, not any number of them
    text = "request 123e4567-e89b-12d3-a456-426614174000 and 12345678901234567890 done"
    one = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in secrets.redact_secrets(one, formats).collect()} == {1: text, 2: None}


def test_too_few_values_teach_nothing(spark):
    few = spark.createDataFrame([(i, f"token=ab{i}cdefgh123456") for i in range(9)], "doc_id long, text string")
    assert secrets.infer_formats(few) == {}
    assert secrets.infer_formats(few.limit(0)) == {} and secrets.scan_secrets(few.limit(0)).count() == 0


def test_the_background_is_learned_from_every_run(spark):
    rnd = random.Random(10)
    runs = [f"{rnd.choice('abcdef')}{i:09d}{'XY'[i % 2] * (i % 23)}" for i in range(3000)] + ["g1" * 400 + "Z" * 7]
    rows = [f"see {x} and token=abcdefgh{i} here" for i, x in enumerate(runs)] + [f"again {runs[0]}"] * 500 + ["internationalisation", None, ""]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert secrets.infer_background(df).logs == secrets.Background(sorted(runs)).logs
    g, z = secrets._CLASS["g"], secrets._CLASS["Z"]
    told = secrets.followers(["g1" * 400 + "Z" * 8])  # a run of any length is read to its end, and counts as 256 characters
    assert sum(told.values()) <= 256 * secrets._UNIT and told[z, z] == 7 * (told[len(secrets._SIZE), g]) > 0
    words = secrets.infer_background(df, digit=False)
    assert words.logs == secrets.Background([*runs, "internationalisation"]).logs
