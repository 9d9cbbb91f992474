"""Tables of OCR markdown, as pipes or HTML: a rectangle of cells whose first rows may be the header.

What a row is, is read from the kinds of its cells: a blank, a figure (digits and signs alone), a label with digits, a label
of words, or a longer text.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser
from itertools import takewhile, zip_longest

SEPARATOR = re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)*\|?\s*$")
#: Characters that a label has at most, and rows below the header that may belong to it.
LABEL, SUBHEADERS = 40, 2
_TAG = re.compile(r"<[^>]+>")
BLANK, FIGURE, NUMBERED, WORDS, LONG = " fnwl"
_FIGURE = re.compile(r"[\d.,%() -]+")
#: Rows by their cells' kinds: two labels or more and nothing but labels; labels of words that start after a blank.
_HEADER, _SUBHEADER = re.compile("(?: *[nw]){2}[ nw]*"), re.compile(" [ w]*w[ w]*")


def clean_cell(s: str) -> str:
    """A cell's text: tags become spaces, entities characters, white space one space."""
    if "<" in s or "&" in s:
        s = html.unescape(_TAG.sub(" ", s))
    return " ".join(s.split())


def cell_kind(c: str) -> str:
    if not c:
        return BLANK
    if _FIGURE.fullmatch(c):
        return FIGURE
    if len(c) > LABEL:
        return LONG
    return NUMBERED if re.search("[0-9]", c) else WORDS


def kinds(row: list[str]) -> str:
    return "".join(map(cell_kind, row))


def looks_like_header(row: list[str]) -> bool:
    return bool(_HEADER.fullmatch(kinds(row)))


@dataclass
class Table:
    header: list[list[str]]
    rows: list[list[str]]
    row_pages: list[int | None] = field(default_factory=list)

    def columns(self) -> list[tuple[str, ...]]:
        """Columns from top to bottom, header cells first; short rows end in blanks."""
        return list(zip_longest(*self.header, *self.rows, fillvalue=""))

    @property
    def width(self) -> int:
        return max(map(len, (*self.header, *self.rows)), default=0)

    def _of(self, columns: list[tuple[str, ...]]) -> Table:
        lines = [list(r) for r in zip(*columns)] or [[] for _ in (*self.header, *self.rows)]
        return Table(lines[: len(self.header)], lines[len(self.header) :], self.row_pages)

    def squared(self) -> Table:
        return self if len(set(map(len, (*self.header, *self.rows)))) < 2 else self._of(self.columns())

    def without_empty(self) -> Table:
        return self._of([c for c in self.columns() if any(c)])

    def names(self) -> list[str]:
        """For each column its different header cells, from the top, joined."""
        depth = len(self.header)
        return [" / ".join(filter(None, dict.fromkeys(c[:depth]))) for c in zip_longest(*self.header, [""] * self.width, fillvalue="")]

    def same_shape(self, other: Table) -> bool:
        """As many columns, and not two headers that differ."""
        headed = {tuple(t.names()) for t in (self, other) if t.header}
        return self.width == other.width and len(headed) < 2

    def with_subheaders(self) -> Table:
        """The first rows below a header that hold only labels, none in the first column, go to the header."""
        n = len(list(takewhile(lambda r: _SUBHEADER.fullmatch(kinds(r)), self.rows[:SUBHEADERS]))) if self.header else 0
        return Table(self.header + self.rows[:n], self.rows[n:], self.row_pages[n:])

    def markdown(self, rows: list[list[str]] | None = None) -> str:
        line = lambda r: "| " + " | ".join(r) + " |"
        names = self.names() if self.header else []
        head = [line(names), "|" + "---|" * len(names)] if any(names) else []
        return "\n".join([*head, *(line(r) for r in (self.rows if rows is None else rows) if any(r))])


def pipe_table(lines: list[str]) -> Table:
    """What stands above the first line of dashes is the header; later ones are rows."""
    above = any(map(SEPARATOR.match, lines))
    out = Table([], [])
    for line in lines:
        if above and SEPARATOR.match(line):
            above = False
            continue
        inner = line.strip().removeprefix("|").removesuffix("|")
        cells = inner.split("|")
        cells = list(map(clean_cell, cells)) if "<" in line or "&" in line else [" ".join(c.split()) for c in cells]
        (out.header if above else out.rows).append(cells)
    return out.squared().with_subheaders()


def _spans(attrs: list[tuple[str, str | None]]) -> tuple[int, int]:
    """(rows, columns) that a cell spans."""
    a = dict(attrs)
    num = lambda k: max(1, int(m[0])) if (m := re.match(r"\d+", a.get(k) or "")) else 1
    return num("rowspan"), num("colspan")


class _Grid(HTMLParser):
    """Cells of a table with spans written out by repetition."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.rows: list[list[tuple[str, bool]]] = []
        self.over: dict[tuple[int, int], tuple[str, bool]] = {}
        self.cell: list[str] | None = None
        self.spans, self.is_head, self.in_head, self.first_span = (1, 1), False, False, 1

    def handle_starttag(self, tag, attrs):
        self.opened(tag, _spans(attrs) if tag in ("td", "th") else (1, 1))

    def opened(self, tag: str, spans: tuple[int, int]) -> None:
        if tag in ("td", "th"):
            self._close()
            self.cell, self.spans, self.is_head = [], spans, tag == "th" or self.in_head
        elif tag == "tr":
            self._close()
            self.rows.append([])
        elif tag in ("thead", "tbody"):
            self._close()
            self.in_head = tag == "thead"
        elif tag == "br" and self.cell is not None:
            self.cell.append(" ")

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "thead", "table"):
            self._close()
        if tag == "thead":
            self.in_head = False

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_entityref(self, name):
        self.handle_data(html.unescape(f"&{name};"))

    def handle_charref(self, name):
        self.handle_data(html.unescape(f"&#{name};"))

    def _close(self):
        if self.cell is None:
            return
        text, self.cell = " ".join("".join(self.cell).split()), None
        if not self.rows:
            self.rows.append([])
        r, (down, across) = len(self.rows) - 1, self.spans
        if r == 0:
            self.first_span = max(self.first_span, down)
        self._fill(r)
        for _ in range(across):
            c = len(self.rows[r])
            self.rows[r].append((text, self.is_head))
            for d in range(1, down):
                self.over[(r + d, c)] = (text, self.is_head)

    def _fill(self, r: int):
        while self.over and (got := self.over.pop((r, len(self.rows[r])), None)) is not None:
            self.rows[r].append(got)

    def done(self) -> list[list[tuple[str, bool]]]:
        self._close()
        for r in range(len(self.rows)):
            self._fill(r)
        return [r for r in self.rows if r]


#: Tags that only _Grid gives a meaning, and those that it passes over; their text is read like any other.
_MEANT, _PASSED = {"table", "thead", "tbody", "tr", "td", "th", "br"}, {"b", "i", "u", "p", "span", "div", "strong", "em", "sup", "sub", "ul", "ol", "li", "tfoot"}
_TAGS = re.compile("(<[^<>]*>)")
_ATTRIBUTE = "([a-zA-Z][a-zA-Z-]*)(?:=(?:\"([^\"'&<>]*)\"|'([^\"'&<>]*)'|([a-zA-Z0-9_.%#-]+)))?"
_ATTRIBUTES = re.compile(f" +{_ATTRIBUTE}")
_PLAIN = re.compile(f"<(/?)([a-zA-Z]+)((?: +{_ATTRIBUTE})*) *(/?)>")
_REFERENCE = re.compile("&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")


@lru_cache(4096)  # most tables are made of a few different tags
def _plain_tag(tag: str) -> tuple[str, str, tuple[int, int]] | None:
    """("open", "close" or "", name, spans) of a tag without anything unusual; "": nothing for _Grid to do."""
    m = _PLAIN.fullmatch(tag)
    name = m[2].lower() if m else ""
    if name not in _MEANT | _PASSED or m[1] and (m[3] or m[8]) or m[8] and name in _MEANT - {"br"}:
        return None
    if name in _PASSED or m[1] and name in ("br", "tbody") or not m[1] and name == "table":
        return "", name, (1, 1)
    attrs = [(k.lower(), a or b or c) for k, a, b, c in _ATTRIBUTES.findall(m[3])]
    return "close" if m[1] else "open", name, _spans(attrs)


def _grid(source: str) -> _Grid:
    """The source's cells. Where all tags are plain they are taken from the text at once, else HTMLParser reads it."""
    g = _Grid()
    parts = _TAGS.split(source)
    tags, texts = list(map(_plain_tag, parts[1::2])), parts[::2]
    plain = None not in tags and source.count("<") == len(tags)
    if plain and "&" in source:
        plain = len(_REFERENCE.findall(source)) == source.count("&")
        texts = [_REFERENCE.sub(lambda m: html.unescape(m[0]), t) if "&" in t else t for t in texts] if plain else texts
    if not plain:
        g.feed(source)
        return g
    for text, (what, name, spans) in zip(texts, [*tags, ("", "", (1, 1))]):
        if text and g.cell is not None:
            g.cell.append(text)
        if what == "open":
            g.opened(name, spans)
        elif what:
            g.handle_endtag(name)
    return g


def html_table(source: str) -> Table:
    """The header: leading rows of header cells; else the rows that the first row spans; else a first row of labels."""
    g = _grid(source)
    rows = g.done()
    n = len(list(takewhile(lambda r: all(h for _, h in r), rows)))
    text = [[c for c, _ in r] for r in rows]
    if not n and g.first_span > 1:
        n = min(g.first_span, max(0, len(rows) - 1))
    if not n and len(rows) > 1 and looks_like_header(text[0]):
        n = 1
    return Table(text[:n], text[n:]).squared().with_subheaders()


def split_table(t: Table, most: int) -> list[tuple[str, int | None, int | None]]:
    """(markdown, first page, last page) of row groups of at most `most` characters, the header in each; a long row is a group of its own."""
    out, group, pages = [], [], []
    head = len(t.markdown([]))
    size = head

    def flush():
        if group:
            known = [p for p in pages if p is not None]
            out.append((t.markdown(group), min(known, default=None), max(known, default=None)))

    for i, row in enumerate(t.rows):
        # as markdown() writes it: a row between bars on a line of its own, rows of blanks left out
        line = sum(map(len, row)) + 3 * len(row) + 1 if any(row) else 0
        more = line + (size > 0) if line else 0
        if group and size + more > most:
            flush()
            group, pages, size = [], [], head
            more = line + (size > 0) if line else 0
        group.append(row)
        size += more
        pages.append(t.row_pages[i] if i < len(t.row_pages) else None)
    flush()
    return out
