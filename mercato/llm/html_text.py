"""Operator 7, HTML extraction by layout-aware rendering.

A tokenizer splits a page into tags and text, a tree builder adds what HTML
leaves out (ends of paragraphs, list items, cells and options; elements
without an end), visibility rules drop what a browser does not show, and a
renderer writes the visible text: blocks on lines of their own, paragraphs,
headings, lists and tables with blank lines around them, list items with
their mark and indent, table cells aligned in columns, preformatted text as
it is, other white space collapsed.

Cases: a null or empty page has an empty text; broken markup is read as far
as it goes and never fails; length and depth are not limited and the walk does not
recurse; beyond ``MAX_INDENT`` lists and quotes inside each other are not indented further; cell lines over ``MAX_PAD`` do not
widen their column;
repeated rows are rendered alike; an empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Fixed values of HTML: elements without content, with raw content, shown as
# blocks, set apart by blank lines, never shown.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = set(("address article aside body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
              "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section "
              "summary table ul blockquote caption tr").split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl pre blockquote table figure hr".split())
HIDDEN = set("head script style template noembed noframes iframe object audio video canvas svg math datalist title param rp".split())
# Fixed values of HTML: a start tag of the key's set ends an open element of
# the set beside it, unless one of the third set is open in between.
_LISTS, _TABLE = set("ul ol menu dir dl".split()), {"table"}
_ENDS_P = BLOCKS - set("html body option optgroup tr caption legend summary".split())
IMPLIED = [
    (_ENDS_P, {"p"}, set("button td th caption table object".split())),
    ({"li"}, {"li"}, _LISTS | _TABLE),
    (set("dt dd".split()), set("dt dd".split()), _LISTS | _TABLE),
    (set("option optgroup".split()), {"option"}, {"select"}),
    ({"optgroup"}, {"optgroup"}, {"select"}),
    (set("td th tr tbody thead tfoot".split()), set("td th caption colgroup".split()), _TABLE),
    (set("tr tbody thead tfoot".split()), {"tr"}, _TABLE),
    (set("tbody thead tfoot".split()), set("tbody thead tfoot".split()), _TABLE),
    (set("h1 h2 h3 h4 h5 h6".split()), set("h1 h2 h3 h4 h5 h6".split()), BLOCKS),
    ({"a"}, {"a"}, BLOCKS),
]
_ENDED_BY: dict[str, list[tuple[set, set]]] = {}
for _starts, _ended, _fence in IMPLIED:
    for _tag in _starts:
        _ENDED_BY.setdefault(_tag, []).append((_ended, _fence - _ended))

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z) | <[!?][^>]*(?:>|\Z)
    | <(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>""", re.X | re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")
MAX_PAD = 60
MAX_SPAN = {"colspan": 1000, "rowspan": 65534}  # fixed values of HTML
MAX_INDENT = 100  # of marks and quotes around a line


class Node:
    __slots__ = ("tag", "attrs", "inside")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.inside = tag, attrs, []


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(source):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def parse(source: str) -> Node:
    """The tree of a page; text is ``str`` among the children."""
    root = Node("#root", {})
    stack, at, n = [root], 0, len(source)
    places: dict[str, list[int]] = {}  # of the open elements, by tag

    def say(text: str) -> None:
        if text:
            stack[-1].inside.append(html.unescape(text))

    def close(ended: set, fence: set) -> None:
        """End the innermost open element of ``ended`` if none of ``fence`` is
        inside it; steps grow with the tags that are open, not with depth."""
        first = max((places[t][-1] for t in ended if t in places), default=0)
        if first and first > max((at[-1] for t, at in places.items() if t in fence), default=0):
            for node in stack[first:]:
                places[node.tag].pop()
                if not places[node.tag]:
                    del places[node.tag]
            del stack[first:]

    last = source.rfind(">")  # nothing after it is a tag
    while at < n:
        found = at
        while True:
            found = source.find("<", found)
            m = _TOKEN.match(source, found) if 0 <= found <= last or source.startswith("<!", max(found, 0)) else None
            if m or not 0 <= found <= last:
                break
            found += 1
        if not m:
            say(source[at:])
            break
        say(source[at:found])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            if tag == "br":
                stack[-1].inside.append(Node("br", {}))
            elif tag not in VOID:
                inline = tag not in BLOCKS and tag not in ("td", "th", "tbody", "thead", "tfoot")
                close({tag}, BLOCKS | {"td", "th"} if inline else {"table"} - {tag})
            continue
        for ended, fence in _ENDED_BY.get(tag, ()):
            close(ended, fence)
        node = Node(tag, attributes(m["attrs"]) if m["attrs"] else {})
        stack[-1].inside.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(source, at)
            raw = source[at:end.start()]
            if raw:
                node.inside.append(html.unescape(raw) if tag in ("textarea", "title") else raw)
            at = end.end()
        elif tag not in VOID and not (m["attrs"].endswith("/") and tag in ("path", "circle", "rect", "use")):
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
    return root


def shown(node: Node) -> bool:
    a = node.attrs
    return not (node.tag in HIDDEN or "hidden" in a or (node.tag == "dialog" and "open" not in a)
                or (node.tag == "input") or _NOT_SHOWN.search(a.get("style", "")))


class Flow:
    """Lines of visible text with pending breaks, indents and list marks."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []  # of the open line
        self.gap = False           # a blank line goes before what comes next
        self.indent: list[str] = []
        self.mark = ""
        self.space = False

    def open_line(self) -> None:
        if not self.line:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            lead = "".join(self.indent[:MAX_INDENT])
            if self.mark:
                lead = (lead[:len(lead) - len(self.mark)] if len(self.indent) <= MAX_INDENT else lead) + self.mark
                self.mark = ""
            self.line.append(lead)
            self.space = False

    def text(self, text: str) -> None:
        words = _SPACES.sub(" ", text)
        if words == " " or not words:
            self.space = self.space or bool(words and self.line)
            return
        lead = words[0] == " " or self.space
        if self.line and lead:
            self.line.append(" ")
        self.open_line()
        self.line.append(words.strip(" "))
        self.space = words[-1] == " "

    def preformatted(self, text: str) -> None:
        for i, part in enumerate(text.replace("\r\n", "\n").split("\n")):
            if i:
                self.open_line()
                self.end()
            if part:
                self.open_line()
                self.line.append(part)

    def end(self, blank: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False
        self.gap = self.gap or blank

    def rows(self, lines: list[str]) -> None:
        for line in lines:
            self.open_line()
            self.line.append(line)
            self.end()

    def done(self) -> list[str]:
        self.end()
        return self.lines


class Grid:
    """A table's rows of cells; a cell is its lines and its span."""

    def __init__(self):
        self.cells: list[list[tuple[list[str], int]]] = []
        self.over: dict[int, int] = {}  # column: rows that a cell above still covers
        self.column = 0

    def row(self) -> None:
        self.cells.append([])
        self.column = 0

    def covered(self) -> None:
        while self.over.get(self.column, 0) > 0:
            self.over[self.column] -= 1
            self.cells[-1].append(([], 1))
            self.column += 1

    def cell(self, lines: list[str], across: int, down: int) -> None:
        if not self.cells:
            self.row()
        self.covered()
        self.cells[-1].append((lines, across))
        for c in range(self.column, self.column + across):
            if down > 1:
                self.over[c] = down - 1
        self.column += across

    def lines(self) -> list[str]:
        width: dict[int, int] = {}
        for row in self.cells:
            at = 0
            for lines, across in row:
                if across == 1:
                    width[at] = max([width.get(at, 0), *(len(x) for x in lines if len(x) <= MAX_PAD)])
                at += across
        out = []
        for row in self.cells:
            for i in range(max([len(lines) for lines, _ in row], default=0)):
                parts, at = [], 0
                for lines, across in row:
                    own = sum(width.get(c, 0) for c in range(at, at + across)) + 2 * (across - 1)
                    parts.append((lines[i] if i < len(lines) else "").ljust(own))
                    at += across
                out.append("  ".join(parts).rstrip())
        return out


def _span(node: Node, name: str) -> int:
    value = node.attrs.get(name, "1")
    return min(MAX_SPAN[name], max(1, int(value))) if value.isascii() and value.isdigit() and len(value) < 9 else 1


def render(root: Node) -> str:
    """The visible text of a tree."""
    flows, grids = [Flow()], []
    lists: list[list] = []  # [ordered, next number]
    steps: list = [root]
    pre = 0

    while steps:
        step = steps.pop()
        flow = flows[-1]
        if isinstance(step, str):
            if pre:
                flow.preformatted(step)
            else:
                flow.text(step)
            continue
        if isinstance(step, tuple):  # the end of an element
            node, kind = step
            if kind == "cell":
                grids[-1].cell(flows.pop().done(), _span(node, "colspan"), _span(node, "rowspan"))
                continue
            if kind == "table":
                flow.rows(grids.pop().lines())
            elif kind == "list":
                lists.pop()
            elif kind == "indent":
                flow.end()
                flow.indent.pop()
                flow.mark = ""
            elif kind == "pre":
                pre -= 1
            if node.tag in BLOCKS:
                flow.end(node.tag in SPACED and not (kind == "list" and lists))
            continue
        tag = step.tag
        if not shown(step):
            continue
        if tag == "br":
            if flow.line:
                flow.end()
            else:
                flow.gap = bool(flow.lines)
            continue
        kind = ""
        inside = step.inside
        if tag in ("td", "th") and grids:
            flows.append(Flow())
            kind = "cell"
        elif tag == "tr" and grids:
            grids[-1].row()
            kind = "row"
        else:
            if tag in BLOCKS:
                flow.end(tag in SPACED and not (tag in _LISTS and lists))
            if tag == "table":
                grids.append(Grid())
                kind = "table"
            elif tag in ("ul", "ol", "menu", "dir"):
                start = step.attrs.get("start", "1")
                lists.append([tag == "ol", int(start) if start.isascii() and start.isdigit() and len(start) < 9 else 1])
                kind = "list"
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0]:
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                flow.indent.append(" " * len(mark))
                flow.mark = mark
                kind = "indent"
            elif tag in ("dd", "blockquote"):
                flow.indent.append("  ")
                kind = "indent"
            elif tag in ("pre", "textarea"):
                pre += 1
                kind = "pre"
                if tag == "pre" and inside and isinstance(inside[0], str) and inside[0][:1] == "\n":
                    inside = [inside[0][1:], *inside[1:]]
            elif tag == "details" and "open" not in step.attrs:
                inside = [c for c in inside if isinstance(c, Node) and c.tag == "summary"]
        steps.append((step, kind))
        steps.extend(reversed(inside))
    return "\n".join(flows[0].done())


def title_of(root: Node) -> str:
    steps = [root]
    while steps:
        node = steps.pop()
        if node.tag == "title":
            return _SPACES.sub(" ", "".join(c for c in node.inside if isinstance(c, str))).strip(" ")
        if node.tag != "body":
            steps.extend(c for c in reversed(node.inside) if isinstance(c, Node))
    return ""


def extract(source: str | None) -> tuple[str, str]:
    """Title and visible text of a page."""
    root = parse(source or "")
    return title_of(root), render(root)


TEXT = "page_id long, url string, title string, text string, n_chars long, n_lines long"


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page with the columns of ``TEXT``."""
    names = [c.split()[0] for c in TEXT.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                made = [extract(page.as_py()) for page in part.column(2)]
                texts = [m[1] for m in made]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array([m[0] for m in made], pa.string()), pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())], names)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(rows, TEXT)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


QUERIES = {"op7_html_text": op7_html_text}
ORACLE_SQL: dict[str, str] = {}
