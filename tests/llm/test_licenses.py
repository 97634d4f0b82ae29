"""A notice gives its own label, not those of its relatives; chains against a search over all sub-sequences."""

import itertools
import random

from groundwork.llm import licenses


def labels(scanner, text):
    return {s["label"] for s in scanner.scan(licenses.words_of(text.encode())) if s["kind"] == "template"}


def test_notices_of_relatives_are_told_apart():
    scanner = licenses.LicenseScanner(licenses.TEMPLATES, licenses.PHRASES, 4, 12, 0.7)
    for label, texts in licenses.TEMPLATES.items():
        for text in texts:
            assert labels(scanner, f"first words here {text} and more words") == {label}, text
    both = licenses.TEMPLATES["agpl"][0] + " some code in between " * 9 + licenses.TEMPLATES["gpl"][0]
    assert labels(scanner, both) == {"agpl", "gpl"}


def test_many_notices_in_one_text():
    scanner = licenses.LicenseScanner(licenses.TEMPLATES, licenses.PHRASES, 4, 12, 0.7)
    text = (licenses.TEMPLATES["lgpl"][0] + " unrelated words of a text " * 6) * 300
    spans = [s for s in scanner.scan(licenses.words_of(text.encode())) if s["kind"] == "template"]
    assert len(spans) == 300 and {s["label"] for s in spans} == {"lgpl"}


def test_chains_against_all_subsequences():
    """The best chain covers as many words as the best of all sub-sequences of its anchors that advance in both."""
    rnd = random.Random(1)
    words = [f"t{i}" for i in range(40)]
    scanner = licenses.LicenseScanner({"x": [" ".join(words)]}, {}, 3, 5, 0.0)
    for _ in range(200):
        anchors = sorted({(rnd.randrange(60), rnd.randrange(30), rnd.randrange(3, 9)) for _ in range(6)})
        best = 0
        for n in range(1, 7):
            for chain in itertools.combinations(anchors, n):
                covered, fine = chain[0][2], True
                for (b, p, size), (c, q, more) in zip(chain, chain[1:]):
                    over = max(0, b + size - c, p + size - q)
                    fine &= b < c and p < q and over < more and c - (b + size) <= 5 and q - (p + size) <= 40
                    covered += more - over
                best = max(best, covered if fine else 0)
        got = scanner._chains(0, anchors)
        assert max(s["covered"] for s in got) == best
