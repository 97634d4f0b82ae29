"""Pages against an independent layout of the tree that they were written from, and hard pages against the clock."""

import random
import time

import pytest

from groundwork.llm.html_text import visible_text

INLINE, BLOCKS = ("b", "span", "em"), ("div", "p", "section", "ul", "ol", "table", "h2")


def tree(rnd, depth, inside):
    """(tag, hidden, children) or a string; only what HTML allows inside the element."""
    if depth == 0 or rnd.random() < 0.3:
        return " ".join(rnd.choice(("one", "two", "漢字", "a&amp;b", "x")) for _ in range(rnd.randrange(1, 3)))
    tag = rnd.choice(INLINE if inside in ("p", "h2", *INLINE, "td") else BLOCKS + INLINE)
    many = lambda make: [make() for _ in range(rnd.randrange(1, 4))]
    if tag in ("ul", "ol"):
        kids = many(lambda: ("li", rnd.random() < 0.2, many(lambda: tree(rnd, depth - 1, "p"))))
    elif tag == "table":
        kids = many(lambda: ("tr", rnd.random() < 0.1, many(lambda: ("td", False, [tree(rnd, 1, "td")]))))
    else:
        kids = many(lambda: tree(rnd, depth - 1, tag))
    return tag, rnd.random() < 0.15, kids


def written(node, rnd):
    """HTML of the tree; end tags that HTML implies are left out at times, junk end tags come in."""
    if isinstance(node, str):
        return node
    tag, hidden, kids = node
    inner = "".join(written(k, rnd) + ("</i>" if rnd.random() < 0.05 else "") for k in kids)
    end = "" if tag in ("li", "tr", "td") and rnd.random() < 0.5 else f"</{tag}>"
    return f"<{tag}{rnd.choice((' hidden', ' style=display:none', chr(32) + 'title=\"a>b\" hidden')) if hidden else rnd.choice(('', ' class=\"x > y\"', ' id=q'))}>{inner}{end}"


def lines(node):
    """The layout by recursion: a list of lines, None for a blank line; text without a line's end is a string."""
    if isinstance(node, str):
        return [("text", node.replace("&amp;", "&"))]
    tag, hidden, kids = node
    if hidden:
        return []
    if tag == "table":
        rows = [["".join(t for k in cell[2] for _, t in lines(k)) for cell in row[2]] for row in kids if not row[1]]
        wide = lambda t: sum(2 if ord(c) > 0x2E80 else 1 for c in t)
        widths = [max(wide(r[i]) for r in rows if i < len(r)) for i in range(max(map(len, rows), default=0))]
        return [("blank", ""), *(("line", "  ".join(c + " " * (w - wide(c)) for c, w in zip(r, widths)).rstrip()) for r in rows), ("blank", "")]
    if tag in ("ul", "ol"):
        shown = [k for k in kids if not k[1]]
        marks = ["- " if tag == "ul" else f"{i + 1}. " for i in range(len(shown))]
        texts = ["".join(t for c in k[2] for _, t in lines(c)) for k in shown]
        return [("blank", ""), *(("line", m + t) for m, t in zip(marks, texts) if t), ("blank", "")]  # an empty item has no line
    inner = [x for k in kids for x in lines(k)]
    if tag in INLINE:
        return inner
    edge = ("blank", "") if tag in ("p", "h2") else ("break", "")
    return [edge, *inner, edge]


def laid_out(nodes):
    out, now = [], ""

    def end():
        nonlocal now
        if now.strip():
            out.append(now.strip())
        now = ""

    for kind, text in [x for n in nodes for x in lines(n)]:
        if kind == "text":
            now += text
            continue
        end()
        if kind == "line":
            out.append(text)
        elif kind == "blank" and out and out[-1]:
            out.append("")
    end()
    while out and not out[-1]:
        out.pop()
    return "\n".join(out)


def test_random_trees_against_their_layout():
    rnd = random.Random(11)
    for _ in range(1500):
        nodes = [tree(rnd, 3, "body") for _ in range(rnd.randrange(1, 5))]
        page = "".join(written(n, rnd) for n in nodes)
        assert visible_text(page) == laid_out(nodes), page


@pytest.mark.parametrize(
    "page, least",
    [
        ("<a " + '"' * 1_000_000, 1_000_000),
        ("<a =" + "\"'" * 500_000, 1_000_000),
        ("<b " * 333_333, 900_000),
        ("<div>" * 100_000 + "</x>" * 100_000, 0),
        ("<i><table><tr><td>" + "<span>" * 60_000 + "</i>" * 60_000 + "end", 3),
        ('<b ="x>" ' * 110_000 + "end", 3),
        ("<!-- " * 200_000, 0),
        ("<" * 1_000_000, 1_000_000),
        ("<script>" + "</script " * 100_000, 0),
        ("<table><tr>" + "<td rowspan=9999>x" * 20_000 + "<tr><td>y" * 20_000, 40_000),
        ("<table><tr><td>" + "x" * 400_000 + "<tr><td>a<td>b" * 20_000, 400_000),
    ],
    ids=["quotes", "values", "unclosed", "stray", "scoped", "uneven", "comments", "lt", "script", "rowspan", "wide"],
)
def test_a_megabyte_of_hard_markup_takes_seconds(page, least):
    began = time.process_time()
    assert least <= len(visible_text(page)) < 8 * len(page)
    assert time.process_time() - began < 6


def test_tables_span_and_align():
    page = "<table><tr><td rowspan=2>a<td>b<td>c<tr><td>dd<td>e<tr><td colspan=2>wide cell here<td>f<tr><td>漢字<td>x<td>y</table>"
    assert visible_text(page) == "a     b         c\n      dd        e\nwide cell here  f\n漢字  x         y"
    assert visible_text("<table><tr><td>a<td><table><tr><td>b<td>c<tr><td>d</table><td>e</table>") == "a  b c d  e"
    assert visible_text("<pre>\n x\r\n  y</pre>") == " x\n  y" and visible_text("<pre> x</pre>") == " x"


def test_tags_that_never_end_are_text():
    assert visible_text('a <a href="x>y">l</a> 1 < 2 <b') == "a l 1 < 2 <b"
    assert visible_text('<p title=5">one</p><p title="two">three</p>') == "one\n\nthree"
    assert visible_text("<p title='it>one</p>") == "one" and visible_text("x</>y<?php z?>") == "xy"
