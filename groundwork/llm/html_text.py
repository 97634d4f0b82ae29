"""Layout-aware text of web pages.

A tree builder turns a page's tags into balanced open and close events: it implies the tags that authors leave out (a new
paragraph, list item, table row or cell closes the open one; content closes an open head; what is still open is closed at
the end) and drops end tags that match nothing. Shown and hidden elements are in one tree, so hidden ones end by the same
rules; only what is shown becomes events. A renderer lays out all visible text: blocks on lines of their own, headings
and paragraphs between blank lines, list items with a bullet or number, indented by depth, preformatted text as it is, and
table cells padded so that columns align, by display width and with colspan and rowspan. A table inside a cell becomes
part of the cell's line.

The work is linear in the page: the scanner reads every character once, a quote that is never closed is an ordinary
character, a tag that is never closed is text, and whether a tag is open is looked up, not searched for. Layout adds a bounded
number of blanks: lists indent up to DEEPEST levels, and columns align up to WIDEST characters of a line; cells further
right follow two blanks apart.

A null or empty page has an empty text. Pages are taken whole; nothing depends on other rows, so there is no shuffle.
Repeated rows repeat their results.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from groundwork.llm.common import pick, text_blocks, tidy

# Elements by their part in the layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())  # text up to their own end tag
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes object datalist audio video canvas".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption optgroup option".split())
SPACED = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote ul ol table dl figure article".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Any other start tag, or text, ends an open head.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: A start tag closes these open elements, unless one of the bounds is met first.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
#: An end tag reaches no further out than these.
SCOPE = frozenset({"table", "td", "th", "caption", "html", "body"})
#: End tags that reach through cells and captions.
THROUGH = frozenset("table tr tbody thead tfoot body html".split())
#: Start tags inside of these close nothing outside.
APART = frozenset({"template", "noscript", "object"})
# Drawings and formulas: what is never shown in them, elements whose content is text or HTML again, and HTML start tags that end them.
FOREIGN_HIDDEN = frozenset("annotation annotation-xml clippath defs desc lineargradient marker mask metadata pattern radialgradient symbol".split())
FOREIGN_TEXT = frozenset("annotation-xml desc foreignobject mi mn mo ms mtext".split())
ENDS_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strike strong sub sup table tt u ul var".split())
#: Whether an element's text is shown; GRAPHIC: a drawing's own text isn't, that of its text elements is.
SHOWN, GRAPHIC, DARK = 0, 1, 2


#: Lists indent no further than this many levels; columns align up to this many characters of a line.
DEEPEST, WIDEST = 16, 400
#: Numbers of columns and rows that a cell may span.
MOST_COLUMNS, MOST_ROWS = 1000, 65534

_NAME = re.compile(r"[^\s/>]++")
_PLAIN_REST = re.compile(r"[^>\"']*+>")
_UNQUOTED = re.compile(r"[^>\"']*+")
_COMMENT_END = re.compile(r"--!?>")
_ATTR = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"']++))?""")
_BLANK = re.compile(r"[ \t\n\r\f]+")


def _attributes(attrs: str) -> dict[str, str]:
    """Lower-case names and values; the first of a name counts."""
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(attrs):
        out.setdefault(name.lower(), value.strip("\"'"))
    return out


def _hidden(attrs: str) -> bool:
    if not attrs:
        return False
    low = attrs.lower()
    if "hidden" not in low and "none" not in low:
        return False
    given = _attributes(low)
    style = re.sub(r"\s+", "", given.get("style", ""))
    return given.get("hidden", "until-found") != "until-found" or given.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style


class _Scanner:
    """Cuts a page into ("text", text), ("open", name, attributes, self-closing) and ("close", name)."""

    def __init__(self, page: str):
        self.page = page
        self.at = self.given = 0  # what is read, and the text before it that was given
        self.last = {c: page.rfind(c) for c in "\"'>"}  # where no further one follows
        self.quotes = True

    def _tag_end(self, start: int) -> int:
        """The place of the ">" that ends a tag whose name ends at start, or -1."""
        if start > self.last[">"]:
            return -1
        if m := _PLAIN_REST.match(self.page, start):
            return m.end() - 1
        at = start
        while self.quotes:
            at = _UNQUOTED.match(self.page, at).end()
            if at >= len(self.page):
                self.quotes = False  # quotes don't come in pairs: from here on they mean nothing
                break
            c = self.page[at]
            if c == ">":
                return at
            value = self.page[max(start, at - 8) : at].rstrip().endswith("=")  # elsewhere a quote is an ordinary character
            at = self.page.find(c, at + 1) + 1 if value and at < self.last[c] else at + 1
        return self.page.find(">", start)

    def parts(self) -> Iterator[tuple]:
        page, n = self.page, len(self.page)
        while (lt := page.find("<", self.at)) >= 0:
            c = page[lt + 1 : lt + 2]
            closing = c == "/"
            if closing:
                c = page[lt + 2 : lt + 3]
            if c.isascii() and c.isalpha():
                name = _NAME.match(page, lt + 1 + closing)
                end = self._tag_end(name.end())
                if end < 0:
                    break  # no tag can end any more
                if self.given < lt:
                    yield "text", page[self.given : lt]
                self.at = self.given = end + 1
                if closing:
                    yield "close", name[0].lower()
                else:
                    attrs = page[name.end() : end]
                    own = attrs.endswith("/")
                    yield "open", name[0].lower(), attrs[:-1] if own else attrs, own
                continue
            if c == "" or not closing and c not in "!?":
                self.at = lt + 1
                continue
            if self.given < lt:
                yield "text", page[self.given : lt]
            if not closing and page.startswith("<!--", lt):
                if page.startswith((">", "->"), lt + 4):
                    end = page.find(">", lt)
                else:
                    m = _COMMENT_END.search(page, lt + 4)
                    end = m.end() - 1 if m else n
            else:
                end = page.find(">", lt)
            self.at = self.given = n if end < 0 else end + 1
        if self.given < n:
            yield "text", page[self.given :]
        self.at = n

    def raw(self, tag: str) -> str:
        """The text up to the element's own end tag, which is read too."""
        start = self.at
        m = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(self.page, start)
        end = self.page.find(">", m.end()) if m else -1
        self.at = self.given = len(self.page) if end < 0 else end + 1
        return self.page[start : m.start() if m else len(self.page)]


class _Open:
    """The stack of open elements: tag, visibility, whether it belongs to a drawing or formula; and the places of each tag."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, bool]] = []
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, state: int, foreign: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, state, foreign))

    def pop(self) -> tuple[str, int, bool]:
        top = self.stack.pop()
        self.places[top[0]].pop()
        return top

    def last(self, tags: Iterable[str]) -> int:
        """The innermost place of one of the tags, or -1."""
        best, places = -1, self.places
        for t in tags:
            if (p := places.get(t)) and p[-1] > best:
                best = p[-1]
        return best


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("open", tag, attributes), ("text", text, ""), ("close", tag, ""): balanced, hidden subtrees left out."""
    scanner, elements = _Scanner(page), _Open()
    stack = elements.stack

    def cut(size: int) -> Iterator[tuple[str, str, str]]:
        while len(stack) > size:
            tag, state, _ = elements.pop()
            if state == SHOWN:
                yield "close", tag, ""

    def close_open(closes: Iterable[str], bounds: Iterable[str], every: bool = False) -> Iterator[tuple[str, str, str]]:
        bound = max(elements.last(bounds), elements.last(APART))
        while (place := elements.last(closes)) > bound:
            yield from cut(place)
            if not every:
                break

    for kind, value, *rest in scanner.parts():
        if kind == "text":
            if stack and stack[-1][0] == "head" and value.strip(" \t\n\r\f"):
                yield from cut(len(stack) - 1)
            if not stack or stack[-1][1] == SHOWN:
                yield "text", value, ""
            continue
        tag = value
        if kind == "close":
            place = elements.last(HEADING if tag in HEADING else (tag,))
            if place < 0:
                if tag == "p" and (not stack or stack[-1][1] == SHOWN):
                    yield "open", "p", ""
                    yield "close", "p", ""
                continue
            if place >= (elements.last(("template",)) if tag in THROUGH else max(elements.last(SCOPE), elements.last(("template",)))):
                yield from cut(place)
            continue
        attrs, own_end = rest
        if stack and stack[-1][0] == "head" and tag not in IN_HEAD:
            yield from cut(len(stack) - 1)
        foreign = bool(stack) and stack[-1][2] and stack[-1][0] not in FOREIGN_TEXT
        if foreign and tag in ENDS_FOREIGN:
            while stack and stack[-1][2] and stack[-1][0] not in FOREIGN_TEXT:
                yield from cut(len(stack) - 1)
            foreign = False
        if not foreign:
            if tag in IMPLIED:
                yield from close_open(*IMPLIED[tag], tag in ("tbody", "thead", "tfoot", "optgroup"))
            if tag in ENDS_P or tag in ("li", "dt", "dd"):
                yield from close_open(("p",), SCOPE)
            if tag in HEADING and stack and stack[-1][0] in HEADING:
                yield from cut(len(stack) - 1)
        outer = stack[-1][1] if stack else SHOWN
        if outer == DARK or tag in HIDDEN or foreign and tag in FOREIGN_HIDDEN or _hidden(attrs):
            state = DARK
        elif tag == "svg":
            state = GRAPHIC
        elif outer == GRAPHIC:
            state = SHOWN if tag in ("text", "foreignobject") else GRAPHIC
        else:
            state = SHOWN
        if foreign and state == SHOWN and tag == "text":
            yield "text", " ", ""  # texts of a drawing have places of their own
        if own_end and foreign:
            continue
        if tag in RAW:
            text = scanner.raw(tag)
            if state == SHOWN:
                yield "text", text, ""
        elif tag in VOID or own_end and tag not in BLOCK:
            if state == SHOWN:
                yield "open", tag, attrs
                yield "close", tag, ""
        else:
            elements.push(tag, state, foreign or tag in ("svg", "math"))
            if state == SHOWN:
                yield "open", tag, attrs
    yield from cut(0)


def display_width(text: str) -> int:
    """Columns of a terminal: wide characters take two, combining and format ones none."""
    if text.isascii():
        return len(text)
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.category(c) in ("Mn", "Me", "Cf") else 1 for c in text)


class _Page:
    """Lines of a page, or of a table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = True  # nothing, or a blank, stands before what comes next
        self.mark = ""
        self.indent = ""

    def put(self, text: str) -> None:
        if not text.isascii() or "&" in text:
            text = html.unescape(text)
        parts = _BLANK.sub(" ", text)
        if self.gap and parts.startswith(" "):
            parts = parts[1:]
        if parts:
            self.line.append(parts)
            self.gap = parts.endswith(" ")

    def put_as_is(self, text: str) -> None:
        first, *rest = html.unescape(text).replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.line.append(first)
        for x in rest:
            self.end(True)
            self.line.append(x)
        self.gap = False

    def end(self, empty: bool = False) -> None:
        text = "".join(self.line).rstrip()
        if text or empty:
            self.lines.append(self.indent + self.mark + text if self.mark or text else "")
            self.mark = ""
        self.line, self.gap = [], True

    def blank(self) -> None:
        self.end()
        if self.lines and self.lines[-1]:
            self.lines.append("")

    def text(self) -> str:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return "\n".join(self.lines)


class _Table:
    """Cells of a table by row and first column; a cell with rowspan takes its columns in the rows below as well."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, int, str]]] = []  # first column, end column, text
        self.down: list[tuple[int, int, int]] = []  # first column, end column, first row that is free again
        self.reached = self.passed = 0

    def row(self) -> None:
        self.rows.append([])
        self.down = [d for d in self.down if d[2] > len(self.rows)]
        self.reached = self.passed = 0

    def cell(self, text: str, columns: int, rows: int) -> None:
        if not self.rows:
            self.row()
        at, below = self.reached, []
        while self.passed < len(self.down) and self.down[self.passed][0] <= at:
            at = max(at, self.down[self.passed][1])
            self.passed += 1
        self.rows[-1].append((at, at + columns, text))
        self.reached = at + columns
        if rows > 1:
            below = (at, at + columns, len(self.rows) + rows)
            place = bisect_left(self.down, below)
            before = self.down[place - 1] if place else None
            if before and before[1] == at and before[2] == below[2]:
                self.down[place - 1] = (before[0], below[1], below[2])
            else:
                self.down.insert(place, below)
                self.passed += place <= self.passed

    def lines(self) -> list[str]:
        starts = sorted({c[0] for r in self.rows for c in r})
        ends: dict[int, list[tuple[int, int]]] = {}  # by the column where the next cell could start: what has to fit before it
        for row in self.rows:
            for first, end, text in row:
                ends.setdefault(bisect_left(starts, end), []).append((bisect_left(starts, first), display_width(text)))
        offset = [0]
        for column in range(1, len(starts)):
            offset.append(max([offset[-1], *(offset[first] + width + 2 for first, width in ends.get(column, ()))]))
        place = dict(zip(starts, offset))
        out = []
        for row in self.rows:
            if row:
                parts, at = [], 0
                for first, _, text in row:
                    gap = place[first] - at
                    gap = gap if at < place[first] <= WIDEST else 2 if at else 0
                    parts += [" " * gap, text]
                    at += gap + display_width(text)
                out.append("".join(parts).rstrip())
        return out


def _span(attrs: str, name: str, most: int) -> int:
    if name not in attrs.lower():
        return 1
    value = _attributes(attrs).get(name, "")
    return min(most, max(1, int(value[:6]))) if value.isascii() and value.isdigit() else 1


def visible_text(page: str) -> str:
    out = _Page()
    cell: tuple[_Page, int, int] | None = None  # the page that waits for a table cell to end, and the cell's columns and rows
    lists: list[int | None] = []  # the next number, or None for bullets
    tables: list[_Table] = []
    pre, fresh = 0, False  # fresh: a line's end right after <pre> isn't shown
    for kind, value, attrs in events(page):
        if kind == "text":
            if pre:
                out.put_as_is(re.sub(r"^\r?\n", "", value) if fresh else value)
            elif not tables or cell or not value.isspace():
                out.put(value)
            fresh = False
            continue
        fresh = False
        inner = len(tables) > 1  # a table inside a cell: its text joins the cell's
        if kind == "open":
            if value == "br":
                out.end(True)
            elif value == "img":
                if alt := _attributes(attrs).get("alt"):
                    out.put(f" {alt} ")
            elif value in ("td", "th") and tables and not inner and not cell:
                cell, out = (out, _span(attrs, "colspan", MOST_COLUMNS), _span(attrs, "rowspan", MOST_ROWS)), _Page()
            elif value == "tr" and tables and not inner:
                tables[-1].row()
            elif value in BLOCK:
                nested = value in ("ul", "ol", "menu") and lists
                out.blank() if value in SPACED and not nested and not out.mark else out.end()
                if value == "hr":
                    out.lines.append("---")
                elif value in ("ul", "menu"):
                    lists.append(None)
                elif value == "ol":
                    start = _attributes(attrs).get("start", "")
                    lists.append(int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1)
                elif value == "li":
                    out.indent = "  " * min(DEEPEST, max(0, len(lists) - 1))
                    out.mark = "- " if not lists or lists[-1] is None else f"{lists[-1]}. "
                    if lists and lists[-1] is not None:
                        lists[-1] += 1
                elif value == "table":
                    tables.append(_Table())
                elif value == "pre":
                    pre, fresh = pre + 1, True
        elif value in ("td", "th") and cell and not inner:
            text = " ".join(out.text().split())
            out, columns, rows = cell
            cell = None
            tables[-1].cell(text, columns, rows)
        elif value == "table" and tables:
            done = tables.pop()
            out.end()
            out.lines += done.lines()
            out.blank()
        elif value in BLOCK and (value != "tr" or inner):
            if value in ("ul", "ol", "menu") and lists:
                out.end()
                lists.pop()
                out.indent = "  " * min(DEEPEST, len(lists) - 1) if lists else ""
                if not lists:
                    out.blank()
            elif value == "li":
                out.end(bool(out.mark and out.line))
                out.mark = ""
            elif value == "pre":
                pre = max(0, pre - 1)
                out.blank()
            else:
                out.blank() if value in SPACED and not out.mark else out.end()
    return out.text()


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text): the visible text of each page."""
    rows = pick(pages, id_col, html_col, binary=False)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_blocks(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array([visible_text(t) for t in texts], pa.string())], names=["id", "text"])

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("text", T.StringType())])
    return rows.mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)
