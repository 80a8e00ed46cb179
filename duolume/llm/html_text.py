"""Operator 3: layout-aware text of HTML pages.

A small tree builder takes the events of Python's HTML tokenizer, closes what
tags imply (paragraphs, list items, cells, rows, options), and ignores end tags without a
start. Rendering walks the tree: invisible elements give nothing (scripts, styles,
heads, hidden attributes, display:none, closed dialogs; with visibility:hidden, only descendants that are visible again show); blocks stand on lines of their own,
with a blank line around paragraphs, headings, lists and tables; list items have
bullets or numbers (start, value and reversed count), indented by depth; cells of a table are aligned in columns,
which colspan and rowspan stretch over; white space collapses, but not in preformatted text. Formulas, labels and titles
of drawings, values of fields and all options of a selection are inline text; as no scripts or plug-ins
run, noscript, object and canvas show their content, and closed details do, as any reader can open them. Nothing visible is dropped, but
for what a drawing only shows by reference (defs, symbol). Comments, declarations and tags without an end are
what the HTML standard takes them for: they go on to the end of the page.

Null HTML gives null text; empty pages give the empty text. Repeated rows give repeated
results. Elements deeper than MOST_DEPTH aren't nodes of their own: their text goes to
the ancestor at that depth, without layout, and what is invisible there stays so. Visibility
is by elements and attributes; rules of style sheets aren't applied. Empty tables give an empty result. All input columns but the HTML stay; one that is named like the
result is replaced by it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INVISIBLE = frozenset("head script style template title meta link datalist iframe audio video progress meter".split())
#: Parts of drawings and formulas that show nothing where they stand.
UNDRAWN = frozenset("defs symbol clippath mask pattern marker metadata desc".split())
UNWRITTEN = frozenset("annotation annotation-xml".split())
EMBEDDED = frozenset("svg math select".split())
#: What stands between the parts of a formula's element.
BETWEEN = {"mfrac": "/", "msup": "^", "msub": "_", "mtr": " ", "mtable": " "}
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure".split())
CLOSES_P = BLOCKS - {"html", "body", "tbody", "tfoot", "thead", "tr", "td", "th", "caption", "summary", "legend"}
#: start tag -> (what it closes, what it doesn't look beyond)
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, {"html"}),
}
MOST_DEPTH = 200
#: What may stand in a head; anything else that shows ends it.
HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
#: Fields that don't show their value, and elements of which the text is no markup.
VALUELESS = frozenset("hidden checkbox radio password file color range image".split())
RAW_TEXT = frozenset("textarea title".split())
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)", re.I)
_WHITE = re.compile(r"[ \t\n\r\f]+")
_COMMENT_END = re.compile(r"--!?>")
_NUMBER = re.compile(r"[ \t\n\r\f]*([+-]?[0-9]{1,9})")


def _number(text: str | None, default: int) -> int:
    found = _NUMBER.match(text or "")
    return int(found[1]) if found else default


class Node:
    __slots__ = ("attrs", "children", "mute", "tag")

    def __init__(self, tag: str, attrs: dict, mute: bool = False):
        self.tag, self.attrs, self.children = tag, attrs, []
        found = _VISIBILITY.findall(attrs.get("style") or "")
        #: whether its own text is invisible, though descendants may show
        self.mute = found[-1].lower() != "visible" if found else mute

    @property
    def visible(self) -> bool:
        return self.tag not in INVISIBLE and self.unhidden and not (self.tag == "dialog" and "open" not in self.attrs)

    @property
    def unhidden(self) -> bool:
        return "hidden" not in self.attrs and not _NO_DISPLAY.search(self.attrs.get("style") or "")


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]
        self.n_open: dict[str, int] = {}  # by tag

    def _end(self, i: int) -> None:
        """Closes open elements from a place on."""
        gone = self.open[i:]
        del self.open[i:]
        for x in gone:
            self.n_open[x.tag] -= 1
        if i >= MOST_DEPTH and any(x.tag in BLOCKS for x in gone):
            self.open[-1].children.append(" ")

    def _close(self, tags: set[str] | frozenset[str], border: set[str]) -> None:
        # again and again: a row closes its cell and the row before it
        while any(self.n_open.get(x) for x in tags):
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in tags:
                    self._end(i)
                    break
                if self.open[i].tag in border or self.open[i].tag == "template":
                    return
            else:
                return

    def _end_head(self) -> None:
        """A head ends where something stands in it, or in its noscript, that belongs to the body."""
        i = len(self.open) - 1
        while i and self.open[i].tag == "noscript":
            i -= 1
        if self.open[i].tag == "head":
            self._end(i)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P:
            self._close({"p"}, {"table", "td", "th", "button", "div", "li", "blockquote"})
        if tag not in HEAD:
            self._end_head()
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        node = Node(tag, dict(attrs), self.open[-1].mute)
        if tag in VOID or len(self.open) < MOST_DEPTH:
            if not (node.mute and tag in VOID):
                self.open[-1].children.append(node)
        elif node.visible:
            node.children = self.open[-1].children
            if tag in BLOCKS:
                node.children.append(" ")
        if tag not in VOID:
            self.open.append(node)
            self.n_open[tag] = self.n_open.get(tag, 0) + 1
        if tag in RAW_TEXT and not self.foreign and not hasattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS"):
            self.set_cdata_mode(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS and self.open[-1].tag == tag:
            self._end(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1) if self.n_open.get(tag) else ():
            if self.open[i].tag == tag:
                self._end(i)
                return
            if self.open[i].tag == "template":
                return
            # an end tag in a cell doesn't close what stands outside of its table
            if self.open[i].tag in ("td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                return

    def handle_data(self, data: str) -> None:
        if self.cdata_elem in RAW_TEXT and not hasattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS"):
            data = unescape(data)
        if data.strip(" \t\n\r\f"):
            self._end_head()
        if not self.open[-1].mute:
            self.open[-1].children.append(data)

    @property
    def foreign(self) -> bool:
        return bool(self.n_open.get("svg") or self.n_open.get("math"))

    def parse_comment(self, i: int, report: bool = True) -> int:
        for short in ("<!-->", "<!--->"):
            if self.rawdata.startswith(short, i):
                return i + len(short)
        end = _COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else -1

    def parse_html_declaration(self, i: int) -> int:
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        if self.rawdata.startswith("<![CDATA[", i) and self.foreign:
            end = self.rawdata.find("]]>", i)
            if end >= 0:
                self.handle_data(self.rawdata[i + 9 : end])
            return end + 3 if end >= 0 else -1
        return self.rawdata.find(">", i) + 1 or -1

    def finish(self) -> None:
        """The end of the page; a comment, declaration or tag that is open there shows nothing."""
        if not self.cdata_elem and re.match(r"<[!?]|</?[A-Za-z]", self.rawdata):
            self.rawdata = ""
        self.close()


class Lines:
    """Lines of text with inline pieces gathered until a block border."""

    def __init__(self):
        self.out: list[str] = []
        self.now: list[str] = []
        self.blank = False

    def text(self, text: str) -> None:
        self.now.append(text)

    def line(self) -> None:
        text = _WHITE.sub(" ", "".join(self.now)).strip(" ")
        self.now = []
        if text:
            self.add(text)

    def add(self, text: str) -> None:
        if self.blank and self.out:
            self.out.append("")
        self.blank = False
        self.out.append(text)

    def space(self) -> None:
        self.line()
        self.blank = True


def _inside(node: Node, depth: int = 0) -> list[str]:
    lines = Lines()
    _walk(node, lines, depth)
    lines.line()
    return lines.out


def _walk(node: Node, lines: Lines, depth: int) -> None:
    step = -1 if node.tag == "ol" and "reversed" in node.attrs else 1
    count = _number(node.attrs.get("start"), 1 if step > 0 else sum(1 for x in node.children if not isinstance(x, str) and x.tag == "li"))
    for child in node.children:
        if isinstance(child, str):
            lines.text(child)
            continue
        if not child.visible:
            continue
        tag = child.tag
        if tag == "br":
            lines.line()
        elif tag == "hr":
            lines.space()
        elif tag in ("img", "input"):
            lines.text(_shown(child))
        elif tag == "textarea":
            lines.text(f" {_plain(child)} ")
        elif tag in EMBEDDED:
            lines.text(_embedded(child))
        elif tag == "table":
            lines.space()
            for row in _table(child, depth):
                lines.add(row)
            lines.space()
        elif tag == "pre":
            lines.space()
            for row in _plain(child).strip("\n").split("\n"):
                lines.add(row.rstrip())
            lines.space()
        elif tag == "li":
            lines.line()
            count = _number(child.attrs.get("value"), count)
            mark = f"{count}. " if node.tag == "ol" else "- "
            count += step
            got = _inside(child, depth + 1)
            for i, row in enumerate(got):
                lines.add((mark if i == 0 else " " * len(mark)) + row if row else row)
        elif tag in BLOCKS:
            (lines.space if tag in SPACED and not (node.tag == "li" and tag in ("ul", "ol")) else lines.line)()
            _walk(child, lines, depth)
            (lines.space if tag in SPACED and not (node.tag == "li" and tag in ("ul", "ol")) else lines.line)()
        else:
            _walk(child, lines, depth)


def _shown(node: Node) -> str:
    """The inline text of an image or a field."""
    kind = (node.attrs.get("type") or "").lower()
    if node.tag == "img" or kind == "image":
        return f" {node.attrs.get('alt') or ''} "
    return f" {node.attrs.get('value') or node.attrs.get('placeholder') or ''} " if kind not in VALUELESS else ""


def _plain(node: Node) -> str:
    """Text with its white space; blocks stand on lines of their own."""
    out: list[str] = []

    def border() -> None:
        last = next((x for x in reversed(out) if x), "\n")
        if not last.endswith("\n"):
            out.append("\n")

    for x in node.children:
        if isinstance(x, str):
            out.append(x)
        elif not x.visible:
            continue
        elif x.tag == "br":
            out.append("\n")
        elif x.tag in ("img", "input"):
            out.append(_shown(x).strip(" "))
        elif x.tag in EMBEDDED:
            out.append(_embedded(x))
        elif x.tag == "table":
            border()
            out.append("\n".join(_table(x, 0)) + "\n")
        elif x.tag in BLOCKS:
            border()
            out.append(_plain(x))
            border()
        else:
            out.append(_plain(x))
    return "".join(out)


def _embedded(node: Node) -> str:
    """The inline text of a drawing, formula or selection."""
    return _WHITE.sub(" ", {"svg": _drawn, "math": _formula, "select": _options}[node.tag](node))


def _drawn(node: Node) -> str:
    out = []
    for x in node.children:
        if isinstance(x, str) or not x.unhidden or x.tag in UNDRAWN:
            continue
        if x.tag == "title":
            out.append(f" {_plain(x)} ")
        elif x.tag in INVISIBLE:
            continue
        elif x.tag == "text":
            out.append(f" {_label(x)} ")
        elif x.tag == "foreignobject":
            out.append(f" {' '.join(_inside(x))} ")
        else:
            out.append(_drawn(x))
    return "".join(out)


def _label(node: Node) -> str:
    """Text with a space before each part that has a place of its own."""
    parts = (x if isinstance(x, str) else " " * bool(x.attrs.keys() & {"x", "y", "dx", "dy"}) + _label(x) if x.visible and x.tag not in UNDRAWN else "" for x in node.children)
    return "".join(parts)


def _formula(node: Node) -> str:
    between = BETWEEN.get(node.tag, "")
    parts = [x if isinstance(x, str) else _embedded(x) if x.tag in EMBEDDED else _formula(x) for x in node.children if isinstance(x, str) or x.visible and x.tag not in UNWRITTEN]
    return between.join(x.strip() if between else x for x in parts if x.strip() or not between)


def _options(node: Node) -> str:
    """Labels of groups and options, in their order."""
    out = []
    for x in node.children:
        if isinstance(x, str):
            out.append(x)
        elif x.visible and x.tag == "optgroup":
            out.append(f" {x.attrs.get('label') or ''} {_options(x)} ")
        elif x.visible:
            out.append(f" {(x.attrs.get('label') if x.tag == 'option' else '') or _plain(x)} ")
    return "".join(out)


def _rows(node: Node, section: int = 1) -> Iterator[tuple[int, Node | str]]:
    """Rows and loose content, with 0 for a table's head and 2 for its foot, which stand first and last."""
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                yield 0, child
        elif not child.visible:
            continue
        elif child.tag in ("thead", "tbody", "tfoot"):
            yield from _rows(child, ("thead", "tbody", "tfoot").index(child.tag))
        else:
            yield section if child.tag == "tr" else 0, child


#: Characters of a line in a table's cell.
WIDEST = 60


def _wrapped(line: str) -> list[str]:
    """A line of prose as lines of at most WIDEST characters, or one word; lines with columns of their own stay."""
    if len(line) <= WIDEST or " | " in line or "  " in line:
        return [line]
    out, now, size = [], [], -1
    for word in line.split(" "):
        if now and size + 1 + len(word) > WIDEST:
            out.append(" ".join(now))
            now, size = [], -1
        now.append(word)
        size += 1 + len(word)
    return [*out, " ".join(now)]


def _grid(rows: list[Node], depth: int) -> list[list[tuple[int, int, list[str]]]]:
    """(first column, end column, lines) of each row's cells; a place that a cell above reaches into is an empty one."""
    out: list[list[tuple[int, int, list[str]]]] = []
    reach: dict[int, int] = {}  # column -> rows that a cell above still takes
    for r, row in enumerate(rows):
        cells, at = [], 0
        for x in row.children:
            if isinstance(x, str):
                if not x.strip():
                    continue
                span, down, lines = 1, 1, _wrapped(_WHITE.sub(" ", x).strip(" "))
            elif not x.visible:
                continue
            else:
                span = min(max(_number(x.attrs.get("colspan"), 1), 1), 1000)
                down = _number(x.attrs.get("rowspan"), 1)
                down = len(rows) - r if down == 0 else min(max(down, 1), len(rows) - r)
                lines = [y for line in _inside(x, depth) for y in _wrapped(line)]
            while reach.get(at, 0) > 0:
                at += 1
            cells.append((at, at + span, lines))
            if down > 1:
                reach |= {c: down for c in range(at, at + span)}
            at += span
        reach = {c: n - 1 for c, n in reach.items() if n > 1}
        out.append(cells)
    # columns in which no cell starts are part of the one before
    firsts = sorted({c[0] for cells in out for c in cells})
    place = {c: i for i, c in enumerate(firsts)}
    return [[(place[a], bisect_left(firsts, b), lines) for a, b, lines in cells] for cells in out]


def _table(table: Node, depth: int) -> list[str]:
    """Rows with cells as wide as the widest of their columns. Prose in cells is wrapped at WIDEST; a longer word, or line of an inner table, sticks out."""
    out: list[str] = []
    rows: list[Node] = []
    for _, child in sorted(_rows(table), key=lambda x: x[0]):
        if isinstance(child, str):
            out.append(_WHITE.sub(" ", child).strip(" "))
        elif child.tag != "tr":
            out += _inside(child, depth)
        else:
            rows.append(child)
    grid = _grid(rows, depth)
    widths = [0] * max((c[1] for cells in grid for c in cells), default=0)
    for first, end, lines in sorted((c for cells in grid for c in cells), key=lambda c: c[1] - c[0]):
        need = max((len(x) for x in lines if len(x) <= WIDEST), default=min(WIDEST, max(map(len, lines), default=0))) - sum(widths[first:end]) - 3 * (end - first - 1)
        widths[end - 1] += max(0, need)
    for cells in grid:
        own = {c[0]: c for c in cells}
        for k in range(max((len(c[2]) for c in cells), default=0)):
            parts, at = [], 0
            while at <= max(own):
                first, end, lines = own.get(at, (at, at + 1, []))
                parts.append((lines[k] if k < len(lines) else "").ljust(sum(widths[first:end]) + 3 * (end - first - 1)))
                at = end
            line = " | ".join(parts)
            if line.strip(" |"):
                out.append(line.rstrip())
    return out


def render(html: str | None) -> str | None:
    """The visible text of one page."""
    if html is None:
        return None
    builder = TreeBuilder()
    builder.feed(html)
    builder.finish()
    return "\n".join(_inside(builder.root)).strip("\n")


def extract_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """All columns but the HTML, and the text. Pages are independent: nothing is shuffled."""

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([render(x) for x in batch], index=batch.index, dtype=object)

    return pages.withColumn(out_col, text_of(F.col(html_col))).drop(*([html_col] if html_col != out_col else []))
