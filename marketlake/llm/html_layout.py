"""Operator 10, HTML extraction by layout-aware rendering.

A tree builder reads tags (void elements, implied ends of the head, of paragraphs, list items, rows and cells, implied
rows, end tags matched inside their table cell), and a renderer walks the tree and writes all visible text: blocks on
lines of their own with blank lines around paragraphs, lists with markers and hanging indents, ``pre`` as it
stands, and tables with columns padded to one width. Text of svg, math and form controls is written with spaces
between its elements. Not visible: head, scripts, styles, templates and embedded
objects, comments, elements with ``hidden`` or ``display:none``, text that is ``visibility:hidden`` (a child may be
visible again), hidden inputs, closed dialogs, ruby's brackets, and what a closed ``details`` holds beside its summary.

Both walks keep their own stacks, so nesting of any depth works. Time and output grow with the page's length: columns of
a table in which no cell begins or ends are left out, a cell longer than ``PAD`` does not widen its column, and indents
stop at ``DEPTH`` levels. Pages are independent rows: one pass, no shuffle. Null html gives null text, an empty page an empty text; repeated rows and
null ids stay; other columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?"
    r"|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>?"
    r"""|<(?P<start>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)|\Z))*+)"""
    r"""(?:>|=\s*+["'].*\Z|\Z)""", re.S)  # a quote opens a string only where a value begins
ATTRIBUTE = re.compile(r"""([^\s>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
SPACE = re.compile(r"[ \t\n\r\f]+")
DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
#: The longest cell that other rows are aligned with, and the deepest indent in levels.
PAD, DEPTH = 120, 40

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe object audio video canvas datalist title rp".split())
#: What may stand in a head; any other start tag, and text, ends it.
HEAD_CONTENT = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
CONTROLS = frozenset("textarea button select input".split())
#: Inside svg and math: what is not drawn, and what a space parts from its neighbours.
FOREIGN = frozenset(("svg", "math"))
UNDRAWN = frozenset("defs desc metadata annotation annotation-xml".split())
PARTED = frozenset("svg math text mi mn mo ms mtext".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr fieldset".split())
BLOCKS = PARAGRAPHS | frozenset(
    "html body address article aside details dialog dd div dt footer form header hgroup legend li main menu nav "
    "section summary caption center option figcaption".split())
CELLS = frozenset(("td", "th"))
SECTIONS = frozenset(("thead", "tbody", "tfoot"))
TABLE_PARTS = CELLS | SECTIONS | {"tr", "caption"}
#: Open elements that a start tag ends, and those beyond which it doesn't look.
IMPLIED = {
    **{t: (frozenset("p"), frozenset(("td", "th", "table", "button", "li", "dd"))) for t in BLOCKS - {"html", "body", "option"}},
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "table"))),
    **{t: (frozenset(("dt", "dd")), frozenset(("dl", "table"))) for t in ("dt", "dd")},
    "option": (frozenset(("option",)), frozenset(("select", "table"))),
    **{t: (CELLS, frozenset(("tr", "table"))) for t in CELLS},
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    **{t: (SECTIONS | {"tr"}, frozenset(("table",))) for t in SECTIONS},
}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _close(stack: list[Node], targets, limits) -> bool:
    """Pop up to the innermost of ``targets`` unless one of ``limits`` is met first."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in targets:
            del stack[i:]
            return True
        if stack[i].tag in limits:
            return False
    return False


def _end_head(stack: list[Node]) -> None:
    """A head is the root's or html's child, and ends where something else begins."""
    for i in range(1, min(3, len(stack))):
        if stack[i].tag == "head":
            if not any(node.tag == "template" for node in stack[i:]):
                del stack[i:]
            return


def parse(html: str) -> Node:
    root = Node("#root", {})
    stack, at, n = [root], 0, len(html)
    open_tags: dict[str, int] = {}
    while at < n:
        m = TOKEN.search(html, at)
        text = html[at:m.start() if m else n]
        if text:
            if len(stack) < 5 and stack[-1].tag in ("head", "noscript") and text.strip():
                _end_head(stack)
            stack[-1].children.append(unescape(text))
        if not m:
            break
        at = m.end()
        if m["end"]:
            tag = m["end"].lower()
            if open_tags.get(tag):  # an end tag without a start is ignored
                inside = frozenset(("table",)) if tag in TABLE_PARTS else CELLS | {"table"}
                _close(stack, (tag,), frozenset() if tag == "table" else inside)
        elif m["start"]:
            tag = m["start"].lower()
            attrs = {k.lower(): unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(m["attrs"])} if m["attrs"] else {}
            if tag == "head" and stack[-1].tag not in ("#root", "html"):
                continue
            if tag not in HEAD_CONTENT:
                _end_head(stack)
            if tag in IMPLIED:
                targets, limits = IMPLIED[tag]
                if any(open_tags.get(t) for t in targets):
                    _close(stack, targets, limits)
                if tag != "p" and open_tags.get("p") and tag in BLOCKS:
                    _close(stack, ("p",), IMPLIED["p"][1])
            if tag in CELLS and stack[-1].tag in ("table", *SECTIONS):
                row = Node("tr", {})
                stack[-1].children.append(row)
                stack.append(row)
                open_tags["tr"] = open_tags.get("tr", 0) + 1
            node = Node(tag, attrs)
            stack[-1].children.append(node)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                body = html[at:end.start() if end else n]
                if body:
                    node.children.append(unescape(body) if tag in ("textarea", "title") else body)
                at = n if not end else (html.find(">", end.end()) + 1 or n)
            elif tag not in VOID and not (m["attrs"] or "").rstrip().endswith("/") or tag in ("p", "div", "li"):
                if tag not in VOID:
                    stack.append(node)
                    open_tags[tag] = open_tags.get(tag, 0) + 1
    return root


def shown(node: Node, inherited: bool) -> bool | None:
    """None: neither the element nor anything in it is drawn. Else whether its own text is visible."""
    a = node.attrs
    if (node.tag in UNSEEN or "hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden")
            or (node.tag == "dialog" and "open" not in a)):
        return None
    style = dict((k.lower(), v.lower()) for k, v in DECLARATION.findall(a["style"])) if "style" in a else {}
    if style.get("display") == "none":
        return None
    return {"visible": True, "hidden": False, "collapse": False}.get(style.get("visibility"), inherited)


class Flow:
    """Lines of text under construction."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.gap, self.space = "", 0, False
        self.indent: list[str] = []
        self.marker = ""

    def _begin(self) -> None:
        if self.gap > 1 and self.lines:
            self.lines.append("")
        self.gap = 0
        if not self.line:
            self.line = "".join(self.indent[:DEPTH])
            if self.marker:
                self.line = self.line[:len(self.line) - len(self.marker)] + self.marker
                self.marker = ""

    def inline(self, text: str) -> None:
        first = True
        for word in SPACE.split(text):
            if not first:
                self.space = True
            if word:
                if self.gap or not self.line:
                    self._begin()
                elif self.space:
                    self.line += " "
                self.line += word
                self.space = False
            first = False

    def end_line(self) -> None:
        if self.line:
            self.lines.append(self.line.rstrip(" "))
            self.line = ""
        self.space = False

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def verbatim(self, rows: list[str]) -> None:
        for row in rows:
            self.end_line()
            if row or self.gap:
                self._begin()
                self.line += row
                self.end_line()
            else:
                self.lines.append("")

    def result(self) -> list[str]:
        self.end_line()
        return self.lines


def _int(text: str | None, default: int, most: int) -> int:
    return min(max(int(text), 1), most) if text and text.isascii() and text.isdigit() and len(text) < 10 else default


def table_lines(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Cells (lines, columns, rows) of each row -> lines with aligned columns, two spaces apart."""
    placed, taken = [], {}
    for r, row in enumerate(rows):
        c, out = 0, []
        for lines, across, down in row:
            while taken.get(c, 0) > r:
                c += 1
            out.append((c, lines, across))
            if down > 1:
                for k in range(c, c + across):
                    taken[k] = r + down
            c += across
        placed.append(out)
    edges = {e: i for i, e in enumerate(sorted({e for out in placed for c, _, across in out for e in (c, c + across)}))}
    placed = [[(edges[c], lines, edges[c + across] - edges[c]) for c, lines, across in out] for out in placed]
    width: dict[int, int] = {}

    def wish(lines: list[str]) -> int:
        longest = max(map(len, lines), default=0)
        return longest if longest <= PAD else 0

    for out in placed:
        for c, lines, across in out:
            if across == 1:
                width[c] = max(width.get(c, 0), wish(lines))
    for out in placed:  # what a spanning cell needs beyond its columns is spread over them
        for c, lines, across in out:
            if across > 1:
                short = wish(lines) - sum(width.get(k, 0) + 2 for k in range(c, c + across)) + 2
                for i in range(across if short > 0 else 0):
                    width[c + i] = width.get(c + i, 0) + (short + i) // across
    text = []
    for out in placed:
        for k in range(max((len(lines) for _, lines, _ in out), default=0)):
            line, start, at = "", 0, 0
            for c, lines, across in out:
                while at < c:  # columns held by a cell above, or without a cell
                    start += width.get(at, 0) + 2
                    at += 1
                if k < len(lines) and lines[k]:
                    line = (line.ljust(start) if not line or len(line) + 2 <= start else line + "  ") + lines[k]
                for at in range(c + 1, c + across + 1):
                    start += width.get(at - 1, 0) + 2
            text.append(line.rstrip())
    return text


def render(html: str) -> str:
    """All visible text of a page."""
    top = flow = Flow()
    flows: list[Flow] = []
    tables: list[list[list]] = []
    lists: list[int | None] = []
    pre = foreign = 0
    seen = [True]
    todo: list = [(parse(html), False)]
    while todo:
        item, leave = todo.pop()
        if isinstance(item, str):
            if not seen[-1]:
                flow.space = flow.space or bool(item)
            elif pre:
                rows = item.replace("\r\n", "\n").split("\n")
                for i, row in enumerate(rows):
                    if i:
                        if flow.line:
                            flow.end_line()
                        elif not flow.gap:
                            flow.lines.append("")
                    if row:
                        if flow.gap or not flow.line:
                            flow._begin()
                        flow.line += row
            else:
                flow.inline(item)
            continue
        tag = item.tag
        if not leave:
            own = shown(item, seen[-1])
            if own is None or foreign and tag in UNDRAWN:
                continue
            foreign += tag in FOREIGN
            if foreign and tag in PARTED or tag in CONTROLS:
                flow.space = True
            if tag == "br":
                if flow.line:
                    flow.end_line()
                elif not flow.gap:
                    flow.lines.append("")
                continue
            children = item.children
            if tag == "details" and "open" not in item.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            if tag in CELLS and tables:
                flows.append(flow)
                flow = Flow()
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag == "table":
                flow.block(2)
                tables.append([])
                flows.append(flow)
                flow = Flow()  # a caption, or text beside the cells
            elif tag in BLOCKS:
                flow.block(2 if tag in PARAGRAPHS and not (tag in ("ul", "ol") and lists) else 1)
            if tag in ("ul", "ol", "menu"):
                start = item.attrs.get("start", "1")
                lists.append((int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1) if tag == "ol" else None)
            elif tag == "li":
                mark = "- "
                if lists and lists[-1] is not None:
                    if re.fullmatch(r"-?[0-9]{1,9}", item.attrs.get("value", "")):
                        lists[-1] = int(item.attrs["value"])
                    mark = f"{lists[-1]}. "
                    lists[-1] += 1
                flow.indent.append(" " * len(mark))
                flow.marker = mark if own else ""
            elif tag == "blockquote" or tag == "dd":
                flow.indent.append("  ")
            elif tag == "pre":
                pre += 1
            seen.append(own)
            todo.append((item, True))
            todo.extend((c, False) for c in reversed(children))
            continue
        seen.pop()
        if foreign and tag in PARTED or tag in CONTROLS:
            flow.space = True
        foreign -= tag in FOREIGN
        if tag in CELLS and tables:
            if not tables[-1]:
                tables[-1].append([])
            cell = flow.result()
            flow = flows.pop()
            tables[-1][-1].append((cell, _int(item.attrs.get("colspan"), 1, 1000), _int(item.attrs.get("rowspan"), 1, 65534)))
        elif tag == "table":
            loose, rows = flow.result(), table_lines(tables.pop())
            flow = flows.pop()
            flow.verbatim(loose + rows)
            flow.block(2)
        elif tag in BLOCKS:
            if tag in ("ul", "ol", "menu"):
                lists.pop()
            flow.block(2 if tag in PARAGRAPHS and not (tag in ("ul", "ol") and lists) else 1)
            if tag in ("li", "blockquote", "dd"):
                flow.indent.pop()
                flow.marker = "" if tag == "li" else flow.marker
            elif tag == "pre":
                pre -= 1
    return "\n".join(top.result())


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if h is None else render(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["page_id", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).mapInArrow(
        run, f"page_id {kind}, text string")
