"""Alignment against whole texts' tokens from the public libraries and all pairs of their byte ranges."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from groundwork.llm import align
from groundwork.llm.q_align import op11_token_alignment
from groundwork.llm.token_counts import byte_symbols

A = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
B = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()


def test_galloping_finds_places():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.choice((1, 5, 50, 5000)))
        into = np.sort(rng.choice(2 * n, n, replace=False))
        values = np.sort(rng.integers(-1, 2 * n, rng.integers(0, 60)))
        want = np.searchsorted(into, values)
        start = np.maximum(0, want - rng.integers(0, n + 1, len(values)))
        assert (align.gallop(values, into, start) == want).all()


class Plain:
    def __init__(self):
        self.a, self.b = Tokenizer.from_str(A), sentencepiece.SentencePieceProcessor(model_proto=B)
        self.a.encode_special_tokens = True
        self.of = {c: i for i, c in enumerate(byte_symbols())}

    def spans(self, parts):
        out, at = [], 0
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    def align(self, text):
        """(a ids, b ids, groups, links) of a whole text."""
        if not text:
            return [], [], [], []
        coded = self.a.encode(" " + text, add_special_tokens=False)
        b = self.b.encode(text)
        a_parts = [bytes(self.of[c] for c in t) for t in coded.tokens]
        b_parts = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, self.b.id_to_piece(b))]
        if not b"".join(a_parts) == b"".join(b_parts) == b" " + text.encode():
            return [], [], [], []
        x, y = self.spans(a_parts), self.spans(b_parts)
        links = [(coded.ids[i], b[k]) for i, (s, e) in enumerate(x) for k, (u, v) in enumerate(y) if s < v and u < e]
        ends, groups, i, k = {e for _, e in x} & {e for _, e in y}, [], 0, 0
        for end in sorted(ends):
            ga, gb = [], []
            while i < len(x) and x[i][1] <= end:
                ga.append(coded.ids[i])
                i += 1
            while k < len(y) and y[k][1] <= end:
                gb.append(b[k])
                k += 1
            groups.append((ga, gb))
        return coded.ids, b, groups, links


def plain_rows(rows):
    plain = Plain()
    done = [(i, plain.align(t)) for i, t in rows]
    counts = Counter(x for _, (*_, links) in done for x in links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    for i, (a, b, groups, links) in done:
        told = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        yield (i, len(a), len(b), len(groups), hashlib.sha256(told.encode()).hexdigest() if a else "", len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links))


def texts(rng):
    alphabet = list("abceinrst ,.\n\t 019Aé") + ["  ", " the", "ing ", "ß", "漢", "字", "🙂", "<|endoftext|>", "<s>", "<0x0A>", " ", "\x1c", "᠎", " ", "\x85", "​", "'s", " 　", "é", "ﬁ"]
    for _ in range(250):
        yield "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60)))
    yield from (None, "", " ", "   ", "x▁y and more", "▁", "a" * 3000, "漢字" * 300, "ab " * 800, "\n", "the same", "the same")


@pytest.mark.parametrize("hot", [align.HOT, 40, 1])
def test_the_query_gives_the_contract(spark, tmp_path, monkeypatch, hot):
    rows = list(enumerate(texts(random.Random(3))))
    rows.append(rows[-1])
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(align.with_link_counts, "__defaults__", (hot,))
    got = op11_token_alignment(spark, str(tmp_path)).select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum")
    assert sorted(map(tuple, got.collect())) == sorted(plain_rows(rows))


def test_edges(spark):
    empty = align.aligned(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert align.with_link_counts(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b", 1, "x"), (2, None, 2, "y")], "doc_id long, text string, row int, links string")
    got = {r.doc_id: r for r in align.with_link_counts(align.aligned(odd, A, B)).collect()}
    assert got[None].groups == "257|264;275|287" and got[None].n_best == 2 and got[2].n_links == got[2].count_sum == 0
