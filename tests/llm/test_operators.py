"""The operators against brute force, public libraries, exact round trips and held-out labels."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from groundwork.llm import bpe, chat, decontam, html_text, langid, licenses, near_dedup, secrets, spotsigs, token_counts

SF = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd_texts(n=400):
    rnd = random.Random(5)
    pick = lambda: chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(128, 0x2FFF), rnd.randrange(0x4E00, 0x9FFF), rnd.choice([9, 10, 13, 0xA0, 0x85, 0x1C, 0x3A3, 0x130, 0x2028, 0x200B, 0x301])]))
    return ["".join(pick() for _ in range(rnd.randrange(60))) for _ in range(n)] + ["a" * k for k in range(12)] + ["<|endoftext|>x <|startoftext|>", " " * 90, "ab" * 90, "x  y", " z"]


def test_bpe_equals_library(spark):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = odd_texts() + [r.text for r in documents(spark).select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode_decode(df, ranks, public_tokenizers.PATTERN).collect():
        assert np.frombuffer(bytes(r.token_ids), "<u4").tolist() == lib.encode_ordinary(texts[r.doc_id])
        assert bytes(r.decoded).decode() == texts[r.doc_id]


def test_bpe_forgets_without_changing_results():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    replay = bpe.MergeReplay(ranks)
    small, large = bpe.BlockEncoder(replay, public_tokenizers.PATTERN, remembered=3), bpe.BlockEncoder(replay, public_tokenizers.PATTERN)
    for t in odd_texts(50):
        assert small.encode([t])[0].tolist() == large.encode([t])[0].tolist()


def test_bpe_of_one_long_word_by_itself():
    import time

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    lib, replay = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.MergeReplay(ranks)
    rnd = random.Random(12)
    for n in (0, 1, 2, 3, 50, 3000):
        for chars in ("a", "abc", "thein "):
            word = "".join(rnd.choice(chars) for _ in range(n)).encode()
            assert replay.one_by_one(word) == (lib._core_bpe.encode_single_piece(word) if word else [])
    began = time.process_time()
    replay.one_by_one(b"abcdefgh" * 25_000)
    assert time.process_time() - began < 10


def test_token_counts_equal_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    texts = odd_texts() + [r.text for r in documents(spark).select("text").collect()]
    with open(path, encoding="utf-8") as f:
        got = token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), f.read()).collect()
    assert all(r.n_tokens == len(lib.encode(texts[r.doc_id], add_special_tokens=False).ids) for r in got)


def test_license_phrases_against_brute_force():
    rnd, words = random.Random(2), b"gnu general public license apache cc by mit the of x".split()
    scanner = licenses.LicenseScanner(licenses.TEMPLATES, licenses.PHRASES, 4, 12, 0.7)
    for _ in range(2000):
        text = [rnd.choice(words) for _ in range(rnd.randrange(30))]
        want = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(text)) if text[i : i + len(p.split())] == p.encode().split())
        assert want == sorted((s["first_word"], s["label"]) for s in scanner.scan(text) if s["kind"] == "phrase")


def test_license_templates_with_changes():
    scanner = licenses.LicenseScanner(licenses.TEMPLATES, licenses.PHRASES, 4, 12, 0.7)
    for label, options in licenses.TEMPLATES.items():
        for text in options:
            ws = licenses.words_of(text.encode())
            for changed in (ws, ws[: len(ws) // 2] + [b"zzz"] + ws[len(ws) // 2 + 1 :] if len(ws) > 30 else ws):
                assert label in {s["label"] for s in scanner.scan([b"before", *changed, b"after"]) if s["kind"] == "template"}


def test_matching_statistics_against_brute_force():
    rnd = random.Random(3)
    for _ in range(60):
        texts = [[rnd.randrange(1, 4) for _ in range(rnd.randrange(1, 12))] for _ in range(3)]
        auto = licenses.SuffixAutomaton(texts)
        parts = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i, len(t) + 1)}
        query = [rnd.randrange(1, 5) for _ in range(40)]
        for i, (_, length) in enumerate(auto.stream(query)):
            assert length == max(k for k in range(i + 2) if tuple(query[i + 1 - k : i + 1]) in parts)


def brute_components(texts, words, percent):
    def shingles(t):
        w = t.encode().lower().split()
        k = min(words, len(w))
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()

    sets, parent = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_near_duplicates_against_all_pairs(spark):
    """A hot group of near copies of one text, chains of edits, exact copies, short texts; blocks smaller than the group."""
    rnd = random.Random(7)
    base = [f"w{rnd.randrange(500)}" for _ in range(60)]
    texts = {}
    for i in range(90):
        copy = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 5])):
            copy[rnd.randrange(len(copy))] = f"e{rnd.randrange(10**6)}"
        texts[i] = " ".join(copy)
    chain = [f"c{k}" for k in range(40)]
    for i in range(90, 120):
        chain[rnd.randrange(40)] = f"n{i}"
        texts[i] = " ".join(chain)
    texts |= {120: "a b", 121: "A  b", 122: "a", 123: "", 124: " "}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for words, percent in ((3, 85), (5, 80)):
        want = brute_components(texts, words, percent)
        got = near_dedup.near_duplicates(df, words, percent, block=16).collect()
        assert {r.doc_id: r.component_id for r in got} == want and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_super_min_hash_estimates_jaccard():
    rnd = np.random.default_rng(1)
    a = rnd.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate((a[:200], rnd.integers(0, 2**63, 100).astype(np.uint64)))
    slots = near_dedup.super_min_hash(np.concatenate((a, b)), np.repeat([0, 1], 300), 2, 200)
    assert abs((slots[0] == slots[1]).mean() - 0.5) < 0.12


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.component for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 21)}, **{i: 100 for i in range(101, 140)}}


def test_spot_signatures_against_brute_force(spark):
    def brute(text):
        import re

        words, out, anchors, k = re.sub(r"[^\w]+|_+", " ", text.lower()).split(), [], set(spotsigs.ANCHORS), 0
        content = [w for w in words if w not in anchors]
        for i, w in enumerate(words):
            if w not in anchors:
                if i and words[i - 1] in anchors:
                    run = i
                    while run and words[run - 1] in anchors:
                        run -= 1
                    out.append(("_".join([*words[run:i], w]), *content[k + 1 : k + 2]))
                k += 1
        return set(out)

    df = documents(spark).limit(120).select("doc_id", "text", spotsigs.signatures(F.col("text")).alias("s"))
    for r in df.collect():
        assert len(r.s) == max(1 if r.text.strip() else 0, len(brute(r.text))) or abs(len(r.s) - len(brute(r.text))) <= 1


def test_spot_pairs_against_brute_force(spark):
    df = documents(spark)
    sets = {r.doc_id: frozenset(r.s) for r in df.select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).collect()}
    pairs, members = spotsigs.similar_pairs(df, 0.7)
    rep = {r.id: r.representative for r in members.collect()}
    assert all(rep[i] == min(j for j in sets if sets[j] == s) for i, s in sets.items() if s)
    reps = sorted(set(rep.values()))
    want = {(a, b) for n, b in enumerate(reps) for a in reps[:n] if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in pairs.collect()} == want


def test_spot_links_against_brute_force(spark):
    from groundwork.llm.q_spots import spot_links

    sets = {r.doc_id: frozenset(r.s) for r in documents(spark).select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).collect()}
    rep = {i: min(j for j in sets if sets[j] == s) if s else i for i, s in sets.items()}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    near = {r: [x for q in set(rep.values()) if q != r and sets[q] and sets[r] and (x := like(q, r)) >= 0.8] for r in set(rep.values())}
    got = {r.doc_id: (r.representative, r.n_links, r.closest) for r in spot_links(spark, SF).collect()}
    assert got == {i: (r, len(near[r]), max(near[r], default=None)) for i, r in rep.items()}
    assert any(n for _, n, _ in got.values()) and any(i != r for i, (r, _, _) in got.items())


def test_spot_query_against_brute_force(spark):
    import re

    from groundwork.llm.q_spots import op5_spot_signatures

    anchors = set(spotsigs.ANCHORS)

    def brute(text):
        words = re.findall(r"[^\W_]+", text.lower())
        content = [i for i, w in enumerate(words) if w not in anchors]
        found = set()
        for n, i in enumerate(content):
            run = content[n - 1] + 1 if n else 0
            if run < i:
                found.add(("_".join(words[run : i + 1]), words[content[n + 1]] if n + 1 < len(content) else None))
        end = content[-1] + 1 if content else 0
        whole = [*words[:end], "".join(w + "_" for w in words[end:])] if end < len(words) else words
        return found or {(" ".join(whole), None)}  # a text without a spot counts as a whole, common words at its end glued

    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    down = sorted(texts, reverse=True)
    edited = {a: texts[a][: len(texts[a]) - len(texts[a]) // 2] + texts[b][: len(texts[a]) // 2] for a, b in zip(down, [*down[1:], down[0]])}
    spots = {("own", i): brute(t) for i, t in texts.items()} | {("edited", i): brute(t) for i, t in edited.items()}
    pairs = sorted(set().union(*spots.values()), key=repr)
    hashed = spark.createDataFrame(pairs, "w string, v string").select("w", "v", F.hash("w", "v").alias("h")).collect()
    code = {(r.w, r.v): r.h for r in hashed}
    sets = {k: {code[x] for x in v} for k, v in spots.items()}
    text = lambda s: " ".join(str(h) for h in sorted(s))
    like = lambda a, b: len(a & b) / len(a | b)
    got = op5_spot_signatures(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    after = dict(zip(down, [*down[1:], down[0]]))
    for r in got:
        own, other = sets["own", r.doc_id], sets["edited", r.doc_id]
        assert r.n_chars == len(texts[r.doc_id]) and r.edited_sha256 == hashlib.sha256(edited[r.doc_id].encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (text(own), text(other))
        assert r.near_edited == pytest.approx(like(own, other)) and r.near_next == pytest.approx(like(own, sets["own", after[r.doc_id]]))


def test_next_row_over_ranges(spark):
    rnd = random.Random(4)
    ids = rnd.sample(range(10**6), 300) + [5 * 10**8]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in spotsigs.with_next(df, "doc_id", ["text"], parts=40, cells=7).collect()}
    down = sorted(ids, reverse=True)
    assert got == {a: f"t{b}" for a, b in zip(down, [*down[1:], down[0]])}
    # Repeated ids follow each other by their texts, also where a range begins with them.
    rows = sorted([(i % 40, f"t{rnd.randrange(100)}") for i in range(200)], key=lambda r: (-r[0], r[1]))
    again = spark.createDataFrame(rnd.sample(rows, len(rows)), "doc_id long, text string")
    out = spotsigs.with_next(again, "doc_id", ["text"], {"twice": F.concat("text", "text")}, parts=40, cells=7).collect()
    assert sorted((r.doc_id, r.text, r.next_text) for r in out) == sorted((*a, b[1]) for a, b in zip(rows, [*rows[1:], rows[0]]))
    assert all(r.next_twice == 2 * r.next_text for r in out)


def test_secrets_against_brute_force(spark):
    import re

    rnd = random.Random(6)
    bits = ["token", "SECRET", "api_key", "apikey", "passwd", "=", ":", " ", '"', "'", "abcd1234", "AKIA", "ABCDEF0123456789", "0123456789abcdef" * 2, "x", "ſecret", "é", ".", "\n"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(14))) for _ in range(1500)]

    def brute(t):
        found = [(m.start(), 0, m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        return [(secrets.KINDS[k], a, b) for a, k, b in sorted(found)]

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.scan_secrets(df).collect():
        assert [(s.kind, s.first, s.end) for s in r.spans if s.kind != "format"] == brute(texts[r.doc_id])


def test_learned_formats_tell_credentials_from_words():
    rnd = random.Random(8)
    make = lambda n, chars: "".join(rnd.choice(chars) for _ in range(n))
    access = [make(20, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(300)]
    assign = [make(rnd.choice([18, 24, 40]), "0123456789abcdef") for _ in range(300)]
    scanner = secrets.SecretScanner({"access": secrets.Automaton(access), "assign": secrets.Automaton(assign)}, 0.35)
    unseen = [make(20, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(100)] + [make(30, "0123456789abcdef") for _ in range(100)]
    plain = ["thewordsareverylong2day", "internationalization18n", "see/chapter/three/page12", "www.example.org/index2.html"]
    assert sum(scanner.likely(x) > 0.35 for x in unseen) >= 190 and not any(scanner.likely(x) > 0.35 for x in plain)
    assert sum(len(a.states) for a in scanner.automata.values()) < 120


def test_redaction_leaves_the_rest(spark):
    df = spark.createDataFrame([(1, "a password=abcdef0123456789 b"), (2, "clean"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redact_secrets(df).collect()}
    assert got == {1: "a [SECRET] b", 2: "clean", 3: None}


def test_language_on_held_out_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    p = langid.identify(df, langid.train_on(df)).join(df.select("doc_id", "lang"), "doc_id").filter(langid.held_out())
    right = p.filter("lang = lang_pred").count() / p.count()
    assert right > 0.98


def test_mixture_finds_both_languages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, table = langid.train_on(df)
    texts = {r.lang: r.text for r in df.filter("n_chars between 1500 and 2500").select("lang", "text").collect()}
    model = langid.MixtureModel(langs, table, 3.0, 6)
    both = model.predict([texts["en"] + " " + texts["es"]])[0][2]
    assert {"en", "es"} <= {a for a, share in both if share > 0.2} and len(model.predict([texts["fr"]])[0][2]) == 1


def test_decontamination_against_brute_force(spark):
    rnd = random.Random(9)
    word = lambda: rnd.choice("abc")
    items = {i: " ".join(word() for _ in range(rnd.choice([1, 3, 9, 10, 14]) if i else 12)) for i in range(4)}
    items |= {7: "", 8: None}
    docs = {i: " ".join(word() for _ in range(rnd.randrange(40))) for i in range(60)}
    got = decontam.contamination(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    for r in got.collect():
        ws, hit, found = docs[r.doc_id].split(), set(), set()
        for item, text in items.items():
            its = (text or "").split()
            n = min(10, len(its))
            windows = {tuple(its[i : i + n]) for i in range(len(its) - n + 1)} if n else set()
            for i in range(len(ws) - n + 1):
                if tuple(ws[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
        assert (r.n_hit, list(r["items"])) == (len(hit), sorted(found))


def test_chat_windows_hold_their_contract(spark):
    rnd = random.Random(10)
    bits = ["hello", "<|im_end|>", "<\\|", "\n", "\\", "a b c", "<|im_start|>assistant ok"]
    rows = [(c, t, "system" if t == 0 and c % 2 else rnd.choice(["user", "assistant"]), " ".join(rnd.choice(bits) for _ in range(rnd.randrange(30)))) for c in range(12) for t in range(rnd.randrange(1, 25))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_chats(df, budget=120, history=40)
    for r in chat.read_back(windows).collect():
        own = sorted((t, role, text) for c, t, role, text in rows if c == r.conv_id)
        assert r.roles == [x[1] for x in own] and r.texts == [x[2] for x in own] and r.targets == [x[2] for x in own if x[1] == "assistant"]
    for w in windows.collect():
        shown = w.text.count("<|im_start|>")
        assert w.n_tokens <= 120 or (shown - w.n_repeated == 1 and w.n_repeated <= 1)  # only a turn that is too long by itself
        if w.conv_id % 2 and w.window > 0:
            assert w.text.startswith("<|im_start|>system\n") and w.n_repeated >= 1


def test_html_layout():
    page = """<!doctype html><title>no</title><style>no</style><h1>A &amp; B</h1><p>one<p>two<br>three <b>bold</b>
    <ul><li>a<li>b<ol start=3><li>c</li><li>d</ol></ul><table><tr><th>k<th>value<tr><td>long cell<td>v</table>
    <p hidden>no</p><div style="display: none">no<p>no</div><!-- no <p> --><script>var a = "</p>";</script>
    <pre>x\n  y</pre>end</b></section><noscript>no</noscript>"""
    assert html_text.visible_text(page) == "A & B\n\none\n\ntwo\nthree bold\n\n- a\n- b\n  3. c\n  4. d\n\nk          value\nlong cell  v\n\nx\n  y\n\nend"


@pytest.mark.parametrize(
    "page, want",
    [
        ("<html><head><title>T</title><p>Hello", "Hello"),
        ("<html><head><title>T</title>Hello", "Hello"),
        ("<html><head><meta charset=x><template>no</template><div>a</div>b", "a\nb"),
        ("<ul><li hidden>a<li>b</ul><p>rest", "- b\n\nrest"),
        ("<p style=display:none>no<p>yes<div>x</div>", "yes\n\nx"),
        ("<p hidden>no<li>yes", "- yes"),
        ("<div><span hidden>no</div>yes", "yes"),
        ("<table><tr><td hidden>a<td>b<tr hidden><td>c<tr><td>d</table>rest", "b\nd\n\nrest"),
        ("<table><caption hidden>a<thead hidden><tr><th>h<tbody><tr><td>b</table>rest", "b\n\nrest"),
        ("<dl><dt>k<dd hidden>a<dt>l<dd>b</dl>rest", "k\nl\nb\n\nrest"),
        ("<select><option hidden>a<option>b<optgroup hidden><option>c<optgroup><option>d</select>rest", "b\nd\nrest"),
        ("<div><datalist><option>a</div>rest", "rest"),
        ("<h1 hidden>a<h2>b</h2>c", "b\n\nc"),
        ("<div hidden><p>a<div>b</div></div>rest<ul><li><noscript><li>x</noscript>y</ul>", "rest\n\n- y"),
        ("<template><div>a</template>rest", "rest"),
        ("<p>a <math><semantics><mi>x</mi><mo>=</mo><mn>2</mn><annotation>\\x</annotation></semantics></math> b", "a x=2 b"),
        ("<p>a<svg><title>no</title><style/><defs><text>no</text></defs>no<g><text x=1>b</text><text>c</text></g></svg>d", "a b cd"),
        ("<svg><path d=''><text hidden>no</text><p>yes", "yes"),
        ("<svg><foreignObject><p>a<p hidden>b<p>c</foreignObject></svg>d", "a\n\nc\n\nd"),
    ],
)
def test_html_hidden_elements_end_as_shown_ones(page, want):
    assert html_text.visible_text(page) == want


def test_html_keeps_all_visible_words(spark):
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    for r in pages.collect():
        body = re.sub(r"(?s)<(script|style|title|head)\b.*?</\1>|<!--.*?-->", " ", r.html)
        import html

        want = html.unescape(re.sub(r"<[^>]*>", " ", body)).split()
        assert [w for w in got[r.page_id].replace("\n- ", "\n ").split() if w != "-"] == [w for w in want if w != "-"]
    assert isinstance(pd.Series(got), pd.Series) and hashlib.sha256(b"").hexdigest()


def test_pipeline_stages_keep_clean_documents(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in p.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "secret_scan", "byte_bpe"]
    rows = {r.doc_id: r.text for r in docs.collect()}
    one = p.language_id(spark, docs, SF)
    assert {r.doc_id for r in one.collect()} == {i for i, t in rows.items() if any(map(str.isalpha, t or ""))}
    two = p.near_dedup(spark, docs, SF)
    groups = brute_components(rows, 5, 80)
    assert {r.doc_id for r in two.collect()} == {i for i in rows if groups[i] == i} and two.columns == docs.columns
    four = p.secret_scan(spark, docs, SF)
    assert four.columns == docs.columns and all(r.n_chars == len(r.text) for r in four.collect())
    out = p.run(spark, SF)
    assert out.count() == len({r.doc_id for r in out.collect()})


def test_spans_are_cut_out(spark):
    docs = spark.createDataFrame([(1, "Before, a B c! d, after."), (2, "...a b c d"), (3, "a b x"), (4, None), (5, "a b c d x a b c d")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "A b C d")], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontam.remove_spans(docs, items).collect()}
    assert got == {1: "Before, , after.", 2: "...", 3: "a b x", 4: None, 5: " x "}


def test_long_words_have_the_library_s_counts():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        content = f.read()
    lib, counter, rnd = Tokenizer.from_str(content), token_counts.BlockCounter(token_counts.WordBpe(content)), random.Random(8)
    letters = lambda alphabet, n: "".join(rnd.choice(alphabet) for _ in range(n))
    texts = ["a" * n for n in (4096, 4097, 9001)] + ["ab" * 5000, letters("ab", 9000), letters("etaoinshrdlu", 20_000), letters("语言模型训练数据中文", 5000), "!" * 6001, letters("é\u0301ßΣσ", 6000) + " x " + letters("thea", 7000) + "。"]
    assert counter.count(texts) == [len(lib.encode(x, add_special_tokens=False).ids) for x in texts]
    # The index and the array give the same counts for words of every size.
    words = [letters("abcdeft", n).encode() for n in (1, 2, 3, 10, 100, 1000)] + [b"a" * n for n in range(1, 20)]
    assert [counter.bpe.count_long(w) for w in words] == counter.bpe.count_short(words).tolist()
