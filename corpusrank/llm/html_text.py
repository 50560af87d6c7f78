"""Layout-aware HTML rendering (operator 9): a tree builder with implied tags, visibility rules, and a text layout.

The output has all text that a page shows: blocks on lines of their own with blank lines between paragraphs, list
items with bullets or numbers and hanging indents, preformatted text as written, and table cells in aligned columns.
Formulas, the labels of drawings and the shown option of a menu are text that a page shows, too; what a form's fields
are filled with is not taken for the page's text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_columns, kept_texts, unkept

_MARKUP = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|[!?][^>]*+(?:>|\Z)"
    r"|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|))*+)(?:>|\Z)"
    r"|/[^>a-zA-Z][^>]*+(?:>|\Z))",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>\"']+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_GONE = re.compile(r"display\s*:\s*none", re.I)
_UNSEEN = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)

# fixed values of the HTML standard: element groups
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
DECODED = frozenset(("textarea", "title"))
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes object audio video canvas annotation annotation-xml datalist textarea area base link meta param source track rp".split())
HEAD = frozenset("base link meta noscript script style template title head html".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
BLOCK = CLOSES_P | frozenset("html body tr caption thead tbody tfoot td th optgroup option legend".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu blockquote pre table figure hr fieldset address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu dir".split())
WALLS = frozenset("table td th caption template html body".split())
#: A start tag -> (open elements that it closes, elements beyond which it closes nothing).
IMPLIED = {
    "li": (frozenset(("li",)), LISTS | WALLS),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",)) | WALLS),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",)) | WALLS),
    "option": (frozenset(("option",)), frozenset(("select", "datalist")) | WALLS),
    "tr": (frozenset(("td", "th", "tr", "caption", "colgroup")), frozenset(("table", "template"))),
    "td": (frozenset(("td", "th", "caption")), frozenset(("table", "tr", "template"))),
    "th": (frozenset(("td", "th", "caption")), frozenset(("table", "tr", "template"))),
} | {x: (frozenset("td th tr thead tbody tfoot caption colgroup".split()), frozenset(("table", "template"))) for x in ("thead", "tbody", "tfoot", "caption", "colgroup")}
#: Elements nested deeper than this become siblings; their text stays.
DEPTH = 200
#: Cells wider than this overflow their column instead of widening it.
CELL = 80


class Node:
    """An element: children are nodes and strings."""

    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None) -> None:
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


class TreeBuilder:
    """Builds the element tree of a page, closing and opening what the markup leaves out."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.body = Node("body")
        self.head: Node | None = None
        self.root.children.append(self.body)
        self.stack = [self.root, self.body]

    def feed(self, html: str) -> Node:
        at = 0
        while at < len(html):
            m = _MARKUP.search(html, at)
            if m is None:
                self.text(html[at:])
                break
            if m.start() > at:
                self.text(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                self.close(name)
                continue
            self.open(name, _attributes(m[3]) if m[3] and not m[3].isspace() else {}, bool(m[3]) and m[3].endswith("/"))
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
                inside = html[at : end.start() if end else len(html)]
                if inside:
                    self.stack[-1].children.append(unescape(inside) if name in DECODED else inside)
                at = end.end() if end else len(html)
                self.close(name)
            elif name == "plaintext":
                self.stack[-1].children.append(html[at:])
                break
        return self.root

    def text(self, source: str) -> None:
        if self.head is not None and not source.isspace():
            self.leave_head()
        top = self.stack[-1]
        if top.tag in ("table", "tr", "thead", "tbody", "tfoot") and not source.isspace():
            self.before_table(unescape(source))
        else:
            top.children.append(unescape(source) if "&" in source else source)

    def before_table(self, child: Node | str) -> None:
        """What may not stand in a table's rows is shown before the table."""
        k = max(i for i, n in enumerate(self.stack) if n.tag == "table") if any(n.tag == "table" for n in self.stack) else 0
        siblings = self.stack[k - 1].children if k else self.stack[-1].children
        siblings.insert(next((i for i in range(len(siblings) - 1, -1, -1) if siblings[i] is self.stack[k]), len(siblings)) if k else len(siblings), child)

    def leave_head(self) -> None:
        if self.head is not None:
            del self.stack[self.stack.index(self.head) :]
            self.head = None

    def open(self, name: str, attrs: dict[str, str], closed: bool) -> None:
        if name in ("html", "body"):
            self.leave_head()
            target = self.root if name == "html" else self.body
            target.attrs = attrs | target.attrs
            return
        if name == "head":
            if self.head is None and len(self.stack) == 2:
                self.head = Node("head", attrs)
                self.body.children.append(self.head)
                self.stack.append(self.head)
            return
        if self.head is not None and name not in HEAD:
            self.leave_head()
        if name in CLOSES_P:
            self.close_within(frozenset(("p",)), WALLS | frozenset(("button",)))
        if name in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.stack.pop()
        if name in IMPLIED:
            self.close_within(*IMPLIED[name])
        if name in ("td", "th") and self.stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self.push(Node("tr"))
        node = Node(name, attrs)
        if name in VOID:
            self.stack[-1].children.append(node)
        else:
            self.push(node)
            if closed and any(n.tag in ("svg", "math") for n in self.stack):
                self.stack.remove(node)

    def push(self, node: Node) -> None:
        self.stack[-1].children.append(node)
        if len(self.stack) < DEPTH or node.tag in RAW:
            self.stack.append(node)

    def close_within(self, tags: frozenset[str], walls: frozenset[str]) -> None:
        """Pop to the outermost open element of ``tags`` on this side of the walls."""
        found = None
        for i in range(len(self.stack) - 1, 1, -1):
            if self.stack[i].tag in tags:
                found = i
            elif self.stack[i].tag in walls:
                break
        if found is not None:
            del self.stack[found:]

    def close(self, name: str) -> None:
        if name == "br":
            self.stack[-1].children.append(Node("br"))
            return
        if name == "head":
            self.leave_head()
            return
        if name in ("html", "body"):
            return
        for i in range(len(self.stack) - 1, 1, -1):
            tag = self.stack[i].tag
            if tag == name or name in HEADINGS and tag in HEADINGS:
                if self.head is not None and i <= self.stack.index(self.head):
                    return
                del self.stack[i:]
                return
            if tag in ("td", "th", "caption") and name not in ("table", "tr", "tbody", "thead", "tfoot"):
                break
        if name == "p":
            self.stack[-1].children.append(Node("p"))


class Layout:
    """Lines of text under construction: pending blank lines, indents, and collapsed white space."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0
        self.indent = ""
        self.marker: str | None = None

    def words(self, text: str) -> None:
        parts = _SPACE.split(text)
        if len(parts) == 1 and not text:
            return
        lead, trail = not parts[0], not parts[-1]
        body = " ".join(p for p in parts if p)
        if not body:
            self.space = self.space or bool(self.line)
            return
        if self.line and (self.space or lead):
            self.line.append(" ")
        if not self.line:
            self.begin()
        self.line.append(body)
        self.space = trail

    def begin(self) -> None:
        """A line starts: the blank lines that wait, then indent or item marker."""
        if self.lines:
            self.lines.extend([""] * max(0, self.gap - 1))
        self.gap = 0
        self.line.append(self.indent if self.marker is None else self.marker)
        self.marker = None

    def flush(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False

    def block(self, gap: int) -> None:
        """End the line; ``gap`` 2 asks for a blank line before what follows."""
        self.flush()
        self.gap = max(self.gap, gap)

    def brk(self) -> None:
        if not self.line:
            self.begin()
        self.flush()

    def raw(self, lines: list[str]) -> None:
        for x in lines:
            if not self.line:
                self.begin()
            self.line.append(x)
            self.flush()


def _sees(node: Node, shown: bool) -> bool | None:
    """None: the element is not laid out; else whether its own text shows."""
    attrs = node.attrs
    if node.tag in HIDDEN or "hidden" in attrs or node.tag == "dialog" and "open" not in attrs:
        return None
    style = attrs.get("style")
    if style:
        if _GONE.search(style):
            return None
        m = _UNSEEN.findall(style)
        if m:
            return m[-1].lower() == "visible"
    return shown


def _number(value: str | None, default: int) -> int:
    m = re.match(r"\s*(-?[0-9]{1,6})", value or "")
    return int(m[1]) if m else default


def _shown_children(node: Node) -> list[Node | str]:
    """The children that a page lays out: of a menu those of its shown option, of a drawing its labels."""
    if node.tag == "select" and "multiple" not in node.attrs and _number(node.attrs.get("size"), 1) <= 1:
        options = _within(node, ("option",))
        chosen = next((x for x in reversed(options) if "selected" in x.attrs), options[0] if options else None)
        return chosen.children if chosen is not None else []
    if node.tag == "svg":
        return [x for label in _within(node, ("text", "foreignobject")) for x in (" ", label)]
    return node.children


def _within(node: Node, tags: tuple[str, ...]) -> list[Node]:
    """The outermost elements of these tags that are laid out, in order."""
    out, todo = [], [node]
    while todo:
        top = todo.pop()
        if top.tag in tags:
            out.append(top)
        else:
            todo.extend(c for c in reversed(top.children) if not isinstance(c, str) and _sees(c, True) is not None)
    return out


def _lay(node: Node, out: Layout, shown: bool, pre: bool, depth: int) -> None:
    tag = node.tag
    gap = 2 if tag in SPACED and not (tag in LISTS and depth) else 1 if tag in BLOCK else 0
    if gap:
        out.block(gap)
    indent, inner = out.indent, depth
    if tag in LISTS:
        inner += 1
        count = _number(node.attrs.get("start"), 1)
    elif tag in ("blockquote", "dd"):
        out.indent += "  "
    pre = pre or tag in ("pre", "listing", "xmp")
    children = _shown_children(node)
    shut = tag == "details" and "open" not in node.attrs
    for child in children:
        if isinstance(child, str):
            if not shown or shut:
                continue
            if pre:
                _preformatted(child, out, first=child is children[0])
            else:
                out.words(child)
            continue
        sees = _sees(child, shown)
        if sees is None or shut and child.tag != "summary":
            continue
        if child.tag == "br":
            if sees:
                out.brk()
        elif child.tag == "hr":
            out.block(2)
        elif child.tag == "table":
            out.block(2)
            out.raw(_table(child, sees))
            out.block(2)
        elif child.tag == "li":
            out.block(1)
            if tag == "ol":
                count = _number(child.attrs.get("value"), count)
                mark = f"{count}. "
                count += 1
            else:
                mark = "- "
            held = out.indent
            out.marker = (out.marker if out.marker is not None else held) + mark
            out.indent = held + " " * len(mark)
            _lay(child, out, sees, pre, inner)
            out.block(1)
            out.marker, out.indent = None, held
        else:
            _lay(child, out, sees, pre, inner)
    out.indent = indent
    if gap:
        out.block(gap)


def _preformatted(text: str, out: Layout, first: bool) -> None:
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if first and len(lines) > 1 and not lines[0]:
        del lines[0]
    for i, x in enumerate(lines):
        if i:
            out.brk() if not out.line else out.flush()
        if x:
            if not out.line:
                out.begin()
            out.line.append(x)


def _width(text: str) -> int:
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _cell_lines(node: Node, shown: bool) -> list[str]:
    out = Layout()
    _lay(node, out, shown, False, 0)
    out.flush()
    return out.lines


def _table(table: Node, shown: bool) -> list[str]:
    """The caption, then the rows, with cells in columns of equal width, two spaces apart."""
    rows: list[list[tuple[Node, bool]]] = []
    head: list[str] = []
    todo = [(table, shown)]
    while todo:
        node, seen = todo.pop()
        below = [(c, s) for c in node.children if not isinstance(c, str) and (s := _sees(c, seen)) is not None]
        if node.tag == "tr":
            if below:
                rows.append(below)
            continue
        for child, sees in below:
            if child.tag == "caption":
                head += _cell_lines(child, sees)
            elif child.tag not in ("tr", "thead", "tbody", "tfoot", "colgroup", "col"):
                rows.append([(child, sees)])
        todo.extend(reversed([x for x in below if x[0].tag in ("tr", "thead", "tbody", "tfoot")]))
    grid: list[list[tuple[int, list[str]]]] = []
    held: dict[int, int] = {}
    for row in rows:
        cells, column = [], 0
        for cell, sees in row:
            while held.get(column, 0) > 0:
                held[column] -= 1
                column += 1
            across = min(max(1, _number(cell.attrs.get("colspan"), 1)), 100)
            down = max(1, _number(cell.attrs.get("rowspan"), 1))
            cells.append((column, _cell_lines(cell, sees)))
            for k in range(across):
                if down > 1:
                    held[column + k] = down - 1
            column += across
        for c in held:
            if c >= column and held[c] > 0:
                held[c] -= 1
        grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        for column, lines in cells:
            widths[column] = max(widths.get(column, 0), max((w for w in map(_width, lines) if w <= CELL), default=0))
    starts, at = {}, 0
    for column in sorted(widths):
        starts[column] = at
        at += widths[column] + 2 * (widths[column] > 0)
    out = []
    for cells in grid:
        for k in range(max((len(lines) for _, lines in cells), default=0)):
            line, used = "", 0
            for column, lines in cells:
                if k < len(lines) and lines[k]:
                    pad = starts[column] - used if starts[column] > used else 2 * bool(line)
                    line += " " * pad + lines[k]
                    used += pad + _width(lines[k])
            out.append(line.rstrip())
    return head + out


def render(html: str | None) -> str:
    """The visible text of a page; null and empty pages give an empty text."""
    if not html:
        return ""
    root = TreeBuilder().feed(html.replace("\0", "�") if "\0" in html else html)
    out = Layout()
    sees = _sees(root, True)
    if sees is None:
        return ""
    _lay(root, out, sees, False, 0)
    out.flush()
    return "\n".join(out.lines).strip("\n")


def extract_text(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: page_id) and ``text``, the visible text, of every page.

    A null, empty or wholly hidden page has an empty text.  Rows are kept as they are (repeats, null ids, any length);
    other columns are not read.  Broken markup never fails: what cannot be a tag is text.  An empty table gives an
    empty result.
    """
    keep = keep or ["page_id"]
    given, schema = kept_columns(pages, keep, html)
    read = kept_texts(pages, keep, html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kept, sources in read(batches):
            yield pa.RecordBatch.from_arrays([kept, pa.array(map(render, sources), pa.string())], names=["kept", "visible"])

    found = given.mapInArrow(run, f"kept {schema}, visible string")
    return unkept(found.withColumnRenamed("visible", "text"), keep, "text")
