"""HTML extraction by layout-aware rendering.

A tree builder with implied tags (an opening <li> ends the open one, <p> ends at the next block, table cells end at the
next cell) puts any markup into a tree; visibility rules drop what a browser does not show; a renderer emits all visible
text with block spacing, list marks and aligned table cells.  Every page is worked on by itself, so memory is bounded by
the largest page.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import table

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe object embed applet audio video canvas datalist title meta link noembed noframes desc defs metadata annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure".split())
#: An opening tag of the key ends open elements of the values, up to a border.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"),
    "tr": ("tr", "td", "th", "caption", "colgroup"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), "thead": ("tr", "td", "th", "caption", "colgroup"), "tfoot": ("tbody", "thead", "tr", "td", "th", "caption"),
    "body": ("head",), "rp": ("rt", "rp"), "rt": ("rt", "rp"),
}
#: Elements that implied ends do not reach through.
BORDER = {
    "li": ("ul", "ol", "menu", "dir", "table"), "dt": ("dl", "table"), "dd": ("dl", "table"), "option": ("select",), "optgroup": ("select",),
    "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",), "body": (), "rp": ("ruby",), "rt": ("ruby",),
}
_END_P = BLOCK - {"body", "html", "legend", "summary"}
_IN_HEAD = frozenset("head title meta link base style script noscript template".split())
#: Inline style that hides an element.
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\s*(?:!important\s*)?(?:;|$)", re.I)
_ONE_ATTR = r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)|(?:\"[^\"]*$|'[^']*$)|))?"
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</?[a-zA-Z][^\s/>]*(?:[\s/]++|" + re.sub(r"\((?!\?)", "(?:", _ONE_ATTR) + r")*+(?:>|$)", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(_ONE_ATTR)
_BLANK = re.compile(r"[ \t\n\r\f]+")
#: Blanks that align a column's cells are at most so many times the column's text, or this many; cells beyond the width
#: that this leaves stand out, so that a page laid out by tables does not grow with rows times its longest cell.
PAD_TIMES, PAD_LEAST = 8, 4000


class Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.kids = tag, attrs or {}, []


class Open(list):
    """The open elements, with a count by tag."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.count = Counter()

    def add(self, node: Node) -> None:
        self.append(node)
        self.count[node.tag] += 1

    def cut(self, at: int) -> None:
        """Close all from a place on."""
        for n in self[at:]:
            self.count[n.tag] -= 1
        del self[at:]


def parse(page: str) -> Node:
    """The tree of a page; wrong or missing tags never fail."""
    root = Node("#root")
    stack, at, size = Open(root), 0, len(page)

    def text(raw: str) -> None:
        if raw:
            if stack[-1].tag == "head" and raw.strip():
                stack.cut(len(stack) - 1)
            stack[-1].kids.append(entities.unescape(raw) if "&" in raw else raw)

    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        token, at = m.group(), m.end()
        if token.startswith("<![CDATA["):
            text(token[9:].removesuffix("]]>"))
            continue
        name = _NAME.match(token)
        if token[1] in "!?" or not name:
            continue
        tag = name.group(1).lower()
        if token[1] == "/":
            _close(stack, tag)
            continue
        _imply(stack, tag)
        node = Node(tag, {k.lower(): entities.unescape(a or b or c) for k, a, b, c in _ATTR.findall(token[name.end() :].removesuffix(">"))} if len(token) > name.end() + 1 else None)
        stack[-1].kids.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(page, at)
            raw = page[at : end.start() if end else size]
            node.kids.append(entities.unescape(raw) if tag == "textarea" else raw)
            at = end.end() if end else size
            continue
        stack.add(node)
    return root


def _close(stack: Open, tag: str) -> None:
    if not stack.count[tag]:
        if tag in ("br", "p"):
            stack[-1].kids.append(Node(tag))
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            stack.cut(i)
            return
        if stack[i].tag in ("table", "td", "th") and tag not in BLOCK | {"tr", "td", "th", "tbody", "thead", "tfoot"}:
            return


def _imply(stack: Open, tag: str) -> None:
    if stack[-1].tag == "head" and tag not in _IN_HEAD:
        stack.cut(len(stack) - 1)
    if tag in _END_P and stack.count["p"]:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == "p":
                stack.cut(i)
                break
            if stack[i].tag in ("table", "td", "th", "li", "div", "section", "article", "blockquote", "button", "body"):
                break
    ended, border = ENDS.get(tag), BORDER.get(tag)
    if ended and any(stack.count[x] for x in ended):
        low = len(stack)
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in border:
                break
            if stack[i].tag in ended:
                low = i
        stack.cut(low)


def visible(n: Node) -> bool:
    a = n.attrs
    if n.tag in HIDDEN or "hidden" in a or (n.tag == "input" and a.get("type", "").lower() == "hidden"):
        return False
    if n.tag == "dialog" and "open" not in a:
        return False
    return not (a.get("style") and _UNSEEN.search(a["style"]))


def width(s: str) -> int:
    """Columns of a text: wide characters take two, marks none."""
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Page:
    """Lines under construction: runs of white space collapse, and blocks ask for line ends and blank lines."""

    def __init__(self):
        self.lines, self.now, self.want, self.gap, self.mark = [], "", 0, False, ""
        self.indent: list[str] = []

    def text(self, s: str, pre: bool = False) -> None:
        if pre:
            for i, part in enumerate(s.replace("\r\n", "\n").split("\n")):
                if i:
                    self._emit(True)
                if part:
                    self._open()
                    self.now += part
            return
        words = _BLANK.sub(" ", s)
        if words in ("", " "):
            self.gap = self.gap or (words == " " and bool(self.now))
            return
        if words[0] == " " or self.gap:
            words = (" " if self.now else "") + words.lstrip(" ")
        self.gap = words[-1] == " "
        if not self.now:
            self._open()
        self.now += words.rstrip(" ") if self.gap else words

    def _open(self) -> None:
        if not self.now:
            if self.want and self.lines:
                self.lines.extend([""] * (self.want - 1))
            self.want = 0
            self.now, self.mark = "".join(self.indent) + self.mark, ""

    def _emit(self, always: bool = False) -> None:
        if self.now or always:
            self.lines.append(self.now.rstrip(" "))
        self.now, self.gap = "", False

    def end_line(self, blank: bool = False) -> None:
        self._emit()
        self.want = max(self.want, 2 if blank else 1)

    def done(self) -> str:
        self._emit()
        while self.lines and not self.lines[-1].strip():
            self.lines.pop()
        return "\n".join(self.lines)


def render(page: str) -> str:
    """The visible text of a page."""
    out = Page()
    running = [_walk(parse(page), out, False, 0)]
    while running:  # steps that nest are generators on this stack, so depth is bounded by memory alone
        inner = next(running[-1], None)
        if inner is None:
            running.pop()
        else:
            running.append(inner)
    return out.done()


def _walk(n: Node, out: Page, pre: bool, depth: int):
    """Render the kids of an element; yields the steps inside."""
    number = _first_number(n)
    for kid in n.kids:
        if isinstance(kid, str):
            out.text(kid, pre)
            continue
        tag = kid.tag
        if not visible(kid):
            continue
        if tag == "br":
            out._emit(True)
        elif tag == "hr":
            out.end_line(True)
        elif tag == "img":
            if alt := kid.attrs.get("alt", "").strip():
                out.text(f" {alt} ")
        elif tag == "input":
            if kid.attrs.get("type", "text").lower() in ("submit", "button", "reset") and kid.attrs.get("value"):
                out.text(f" {kid.attrs['value']} ")
        elif tag == "table":
            out.end_line(True)
            yield _table(kid, out, depth)
            out.end_line(True)
        elif tag == "li":
            out.end_line()
            if n.tag == "ol":
                if kid.attrs.get("value", "").lstrip("-").isdigit():
                    number = int(kid.attrs["value"])
                out.mark = f"{number}. "
                number += 1
            else:
                out.mark = "- "
            before = out.mark
            out.indent.append("")
            yield _item(kid, out, pre, depth, len(before))
            out.indent.pop()
            out.mark = ""
            out.end_line()
        elif tag in BLOCK:
            blank = tag in SPACED and not (tag in ("ul", "ol") and depth)
            out.end_line(blank)
            if tag in ("blockquote", "dd"):
                out.indent.append("  ")
            yield _walk(kid, out, pre or tag in ("pre", "textarea", "xmp"), depth + (tag in ("ul", "ol", "menu", "dir")))
            if tag in ("blockquote", "dd"):
                out.indent.pop()
            out.end_line(blank)
        elif tag == "q":
            out.text('"')
            yield _walk(kid, out, pre, depth)
            out.text('"')
        elif tag == "select":
            if (chosen := _chosen(kid)) is not None:
                out.text(" ")
                yield _walk(chosen, out, pre, depth)
                out.text(" ")
        else:
            yield _walk(kid, out, pre or tag in ("textarea", "xmp"), depth)


def _chosen(n: Node) -> Node | None:
    """The option of a select that a page shows: the last one marked so, or the first."""
    options = [k for x in n.kids if isinstance(x, Node) for k in ([x] if x.tag == "option" else x.kids) if isinstance(k, Node) and k.tag == "option"]
    marked = [k for k in options if "selected" in k.attrs]
    return marked[-1] if marked else options[0] if options else None


def _first_number(n: Node) -> int:
    start = n.attrs.get("start", "1") if n.tag == "ol" else "1"
    return int(start) if start.lstrip("-").isdigit() else 1


def _item(kid: Node, out: Page, pre: bool, depth: int, size: int):
    """A list item: its first line bears the mark, later lines and nested lists stand under its text."""
    mark, out.mark = out.mark, ""
    inner = Page()
    yield _walk(kid, inner, pre, depth + 1)
    lines = inner.done().split("\n")
    for i, line in enumerate(lines):
        if not line and i:
            out.lines.append("")
            continue
        out._open()
        out.now += (mark if i == 0 else " " * size) + line
        out.now = out.now.rstrip(" ") if not line else out.now
        out.end_line()


def _table(n: Node, out: Page, depth: int):
    """Rows of a table with cells aligned in columns, parted by two spaces; cells of several lines stay one cell.

    A cell starts at the first column that no cell of a row above spans.
    """
    rows: list[list[tuple[int, int, list[str]]]] = []  # of each cell: first column, columns, lines
    held: dict[int, int] = {}  # rows that a cell above still spans, by column
    parts = [iter(n.kids)]
    while parts:
        kid = next(parts[-1], None)
        if kid is None:
            parts.pop()
        elif isinstance(kid, str):
            out.text(kid)
        elif not visible(kid):
            continue
        elif kid.tag == "tr":
            row, at, below = [], 0, {c: k - 1 for c, k in held.items() if k > 1}
            for cell in kid.kids:
                if isinstance(cell, str):
                    out.text(cell)
                elif visible(cell):
                    inner = Page()
                    yield _walk(cell if cell.tag in ("td", "th") else _wrap(cell), inner, False, depth)
                    while at in held:
                        at += 1
                    wide, high = _span(cell, "colspan", 1000), _span(cell, "rowspan", 65534)
                    row.append((at, wide, inner.done().split("\n")))
                    if high > 1:
                        below |= dict.fromkeys(range(at, at + wide), high - 1)
                    at += wide
            rows.append(row)
            held = below
        elif kid.tag in ("tbody", "thead", "tfoot"):
            held = {}  # a cell spans rows of its own group only
            parts.append(iter(kid.kids))
        elif kid.tag not in ("colgroup", "col"):
            out.end_line()
            yield _walk(_wrap(kid) if kid.tag != "caption" else kid, out, False, depth)
            out.end_line()
    out.end_line()
    widths = _column_widths(rows)
    starts = [0]
    for c in range(max((at + wide for r in rows for at, wide, _ in r), default=0)):
        starts.append(starts[-1] + widths.get(c, 0) + 2)
    for r in rows:
        for k in range(max((len(lines) for *_, lines in r), default=0)):
            line = []
            size = 0
            for at, _, lines in r:
                if k < len(lines) and lines[k]:
                    gap = max(starts[at] - size, 2 if line else 0)
                    line += [" " * gap, lines[k]]
                    size += gap + width(lines[k])
            if line:
                out._open()
                out.now += "".join(line)
                out.end_line()


#: The largest spans of the HTML standard, 1000 columns and 65534 rows.
def _span(cell: Node, name: str, most: int) -> int:
    given = cell.attrs.get(name, "1").strip()
    return min(int(given), most) if given.isascii() and given.isdigit() and len(given) < 9 and int(given) else 1


def _column_widths(rows) -> dict[int, int]:
    """The width of each column: its widest cell, or less where blanks would be far more than the column's text."""
    sizes: dict[int, list[int]] = {}
    for r in rows:
        for at, wide, lines in r:
            if wide == 1:
                sizes.setdefault(at, []).extend(map(width, lines))
    out = {}
    for c, own in sizes.items():
        own.sort()
        room, blanks, out[c] = max(PAD_TIMES * sum(own), PAD_LEAST), 0, own[0]
        for i in range(1, len(own)):  # widen to the next larger cell while the blanks for all smaller ones fit
            blanks += (own[i] - own[i - 1]) * i
            if blanks > room:
                break
            out[c] = own[i]
    return out


def _wrap(n: Node) -> Node:
    w = Node("td")
    w.kids.append(n)
    return w


def extractor():
    """A column function page -> visible text; null gives the empty text."""

    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([render(p) if p else "" for p in pages], dtype="object")

    return F.pandas_udf(run, "string")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: the id, n_chars_html, text and n_chars.

    A null or empty page has the empty text; markup alone too.  Broken markup gives what its tree shows.  Repeated rows
    are rendered each; other columns are not read.  An empty table gives an empty result.
    """
    page = F.coalesce(F.col(html_col), F.lit(""))
    out = pages.select(F.col(id_col), F.length(page).cast("long").alias("n_chars_html"), extractor()(page).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
