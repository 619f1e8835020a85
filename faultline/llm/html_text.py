"""Layout-aware text of HTML pages: a tree builder with implied tags, visibility rules, and a renderer.

All visible text comes out: blocks on lines of their own, paragraphs and
headings apart by a blank line, list items marked and indented, table cells in
aligned columns.
"""

from __future__ import annotations

import bisect
import collections
import hashlib
import html
import itertools
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: One attribute, or what ends a tag.
_ATTR = re.compile(r"[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)|(?=>)|([\"'])))?)")
_UNSEEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_UNSEEN = frozenset("head script style template noscript title iframe object audio video canvas svg datalist noembed noframes".split())
_APART = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure article section hr form fieldset".split())
_BLOCK = _APART | frozenset("address aside body center dd details dialog dir div dt fieldset figcaption footer header hgroup html legend li main menu nav optgroup option search select summary caption tr".split())
#: An opening tag ends these open elements, up to the boundary.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tbody": (("tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "body": (("head",), ("html",)),
}
_ENDS_P = _BLOCK - {"body", "html", "option", "optgroup", "select", "tr", "caption", "legend", "summary"}
#: Where these may stand in a table: other elements still open inside it end first.
_CONTEXT = {
    "tr": ("table", "thead", "tbody", "tfoot"),
    "td": ("table", "thead", "tbody", "tfoot", "tr"),
    "th": ("table", "thead", "tbody", "tfoot", "tr"),
    "thead": ("table",),
    "tbody": ("table",),
    "tfoot": ("table",),
}
_SECTIONS = ("thead", "tbody", "tfoot")
#: Anything else, like text that isn't blank, ends an open head.
_IN_HEAD = frozenset("head base basefont bgsound link meta title style script noscript noframes template".split())
#: The tree isn't deeper than this: elements nested farther share their parent's parts, but keep their place, ends and visibility.
MAX_DEPTH = 200
_CELLS = ("td", "th", "table")
_TABLE_PARTS = ("table", "tr", "tbody", "thead", "tfoot")
#: Columns and rows that a cell may span.
_MOST_COLUMNS, _MOST_ROWS = 1000, 65534


class Node:
    __slots__ = ("tag", "attrs", "parts", "flat")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.parts, self.flat = tag, attrs, [], False


def _attributes(source: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes of a tag whose name ends at ``at``, and where the tag ends; a quote that nothing closes ends with the tag, at the next ``>``, which must exist."""
    out: dict[str, str] = {}
    begin = at
    while m := _ATTR.match(source, at):
        if m[1]:
            return out, m.end()
        if m[6]:
            break
        at = m.end()
        name = m[2].lower()
        if name not in out:
            value = next((v for v in (m[3], m[4], m[5]) if v is not None), "")
            out[name] = html.unescape(value) if "&" in value else value
    return out, source.index(">", begin) + 1


class _Stack:
    """Open elements, the root at 0, with the places of each tag's."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.places = [root], collections.defaultdict(list)

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, to: int) -> None:
        """Ends all from ``to`` on."""
        for node in self.nodes[to:]:
            self.places[node.tag].pop()
            if node.flat and node.tag in _BLOCK:
                node.parts.append(Node("div", {}))
        del self.nodes[to:]

    def nearest(self, tags) -> int:
        """Place of the innermost open element of these tags, 0 if none is."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def close(self, tags, until) -> None:
        """Ends the elements of these tags, and what is in them, up to the boundary."""
        while (i := self.nearest(tags)) > self.nearest(until):
            self.cut(i)


def parse(source: str) -> Node:
    """The tree of a page, in time linear in its length; a tag that no ``>`` ends is text."""
    root = Node("html", {})
    stack = _Stack(root)

    def add(part) -> None:
        stack.nodes[-1].parts.append(part)

    def text(value: str) -> None:
        if value:
            value = html.unescape(value)
            if stack.nodes[-1].tag == "head" and value.strip(" \t\n\r\f"):
                stack.cut(len(stack.nodes) - 1)
            add(value)

    def open_(node: Node) -> None:
        if len(stack.nodes) >= MAX_DEPTH and stack.nodes[-1].tag not in _UNSEEN and _visible(node):
            if node.tag in _BLOCK:
                add(Node("div", {}))
            node.flat, node.parts = True, stack.nodes[-1].parts
        else:
            add(node)
        stack.push(node)

    last = source.rfind(">")
    at, n = 0, len(source)
    begin = 0  # of the text not yet added
    while True:
        at = source.find("<", at)
        if at < 0 or at > last and not source.startswith("<!--", at):
            break
        m = _TAG.match(source, at)
        if m is None:
            if source.startswith("<!--", at):
                text(source[begin:at])
                if source.startswith((">", "->"), at + 4):
                    at = source.index(">", at) + 1
                else:
                    end = source.find("-->", at + 4)
                    at = end + 3 if end >= 0 else n
                begin = at
            elif source.startswith(("<!", "<?", "</"), at) and (source[at + 1] != "/" or source[at + 2 : at + 3].strip()):
                text(source[begin:at])
                at = begin = source.index(">", at) + 1
            else:
                at += 1
            continue
        text(source[begin:at])
        tag = m[2].lower()
        if last < m.end():
            begin = at
            break
        attrs, at = _attributes(source, m.end())
        begin = at
        if m[1]:
            if tag == "p" and not stack.places["p"]:
                add(Node("p", {}))
            elif tag not in ("html", "body"):
                i = stack.nearest((tag,))
                if i and (tag in _TABLE_PARTS or i >= stack.nearest(_CELLS)):
                    stack.cut(i)
            continue
        if tag == "html":
            continue
        if stack.nodes[-1].tag == "head" and tag not in _IN_HEAD:
            stack.cut(len(stack.nodes) - 1)
        if tag in _ENDS:
            stack.close(*_ENDS[tag])
        if tag in _CONTEXT:
            place = stack.nearest(_CONTEXT[tag])
            if place:
                stack.cut(place + 1)
                if tag in ("td", "th") and stack.nodes[-1].tag != "tr":
                    open_(Node("tr", {}))
        if tag in _ENDS_P:
            stack.close(("p",), ("td", "th", "table", "button", "object", "caption"))
        node = Node(tag, attrs)
        if tag in _RAW:
            add(node)
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
            body = source[at : end.start() if end else n]
            node.parts.append(html.unescape(body) if tag in ("textarea", "title") else body)
            at = begin = source.find(">", end.end()) + 1 or n if end else n
        elif tag in _VOID or tag == "form" and stack.nodes[-1].tag in ("table", "tr", *_SECTIONS):
            add(node)  # a form in a table is empty as in browsers: its rows and cells are the table's
        else:
            open_(node)
    text(source[begin:])
    return root


def _visible(node: Node) -> bool:
    a = node.attrs
    if node.tag in _UNSEEN or "hidden" in a or (node.tag == "dialog" and "open" not in a):
        return False
    return not (a.get("style") and _UNSEEN_STYLE.search(a["style"]))


def _width(text: str) -> int:
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.combining(c) else 1 for c in text) if not text.isascii() else len(text)


class Renderer:
    """Lines of text; ``gap`` counts the newlines owed before the next text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.blank = False

    def flush(self) -> None:
        line = _SPACES.sub(" ", "".join(self.inline)).strip(" ")
        self.inline = []
        if line:
            if self.blank and self.lines:
                self.lines.append("")
            self.lines.append(line)
            self.blank = False

    def apart(self) -> None:
        self.flush()
        self.blank = True

    def raw(self, lines: list[str]) -> None:
        self.flush()
        if lines:
            if self.blank and self.lines:
                self.lines.append("")
            self.lines += lines
            self.blank = False

    def walk(self, node: Node) -> None:
        for part in node.parts:
            if isinstance(part, str):
                self.inline.append(part)
            elif _visible(part):
                self.element(part)

    def element(self, node: Node) -> None:
        tag = node.tag
        if tag == "br":
            line = _SPACES.sub(" ", "".join(self.inline)).strip(" ")
            if line:
                self.flush()
        elif tag == "hr":
            self.apart()
        elif tag in ("ul", "ol", "menu", "dir"):
            self.apart() if not node.attrs.get("_nested") else self.flush()
            self.raw(_list(node))
            self.blank = True
        elif tag == "table":
            self.apart()
            self.raw(_table(node))
            self.blank = True
        elif tag == "pre":
            self.apart()
            self.raw([x.rstrip() for x in _plain(node).strip("\n").split("\n")] if _plain(node).strip() else [])
            self.blank = True
        elif tag == "blockquote":
            self.apart()
            self.raw(["> " + x if x else ">" for x in _lines(node)])
            self.blank = True
        elif tag == "dd":
            self.flush()
            self.raw(["  " + x if x else "" for x in _lines(node)])
        elif tag == "details" and "open" not in node.attrs:
            self.flush()
            for part in node.parts:
                if isinstance(part, Node) and part.tag == "summary" and _visible(part):
                    self.walk(part)
                    break
            self.flush()
        elif tag == "input":
            if node.attrs.get("type", "").lower() in ("submit", "button", "reset"):
                self.inline.append(" " + node.attrs.get("value", "") + " ")
        elif tag in _APART:
            self.apart()
            self.walk(node)
            self.apart()
        elif tag in _BLOCK:
            self.flush()
            self.walk(node)
            self.flush()
        elif tag in ("td", "th"):  # a cell without a table
            self.inline.append(" ")
            self.walk(node)
            self.inline.append(" ")
        else:
            self.walk(node)


def _plain(node: Node) -> str:
    out = []
    for part in node.parts:
        if isinstance(part, str):
            out.append(part)
        elif part.tag == "br":
            out.append("\n")
        elif _visible(part):
            out.append(_plain(part))
    return "".join(out)


def _lines(node: Node) -> list[str]:
    r = Renderer()
    r.walk(node)
    r.flush()
    return r.lines


def _list(node: Node) -> list[str]:
    out: list[str] = []
    number = int(node.attrs["start"]) if re.fullmatch(r"-?\d{1,9}", node.attrs.get("start", "")) else 1
    loose = Node("li", {})
    items = []
    for part in node.parts:
        if isinstance(part, Node) and part.tag == "li":
            items.append(part)
        elif isinstance(part, Node) or part.strip():
            if not items or items[-1] is not loose:
                loose = Node("li", {})
                items.append(loose)
            loose.parts.append(part)
    for item in items:
        if not _visible(item):
            continue
        if node.tag == "ol" and re.fullmatch(r"-?\d{1,9}", item.attrs.get("value", "")):
            number = int(item.attrs["value"])
        for part in item.parts:
            if isinstance(part, Node) and part.tag in ("ul", "ol"):
                part.attrs["_nested"] = "1"
        mark = f"{number}. " if node.tag == "ol" else "- "
        number += 1
        lines = [x for x in _lines(item) if x]
        if lines:
            out.append(mark + lines[0])
            out += [" " * len(mark) + x for x in lines[1:]]
    return out


def _rows(node: Node):
    for part in node.parts:
        if isinstance(part, Node) and _visible(part):
            if part.tag == "tr":
                yield part
            elif part.tag in _SECTIONS:
                yield from _rows(part)


def _loose(node: Node):
    """What stands in a table or its sections without being a part of it."""
    for part in node.parts:
        if isinstance(part, str):
            if part.strip():
                yield part
        elif part.tag in _SECTIONS:
            if _visible(part):
                yield from _loose(part)
        elif part.tag not in ("tr", "caption", "colgroup", "col"):
            yield part


def _table(node: Node) -> list[str]:
    """Cells padded to their columns' widths, two blanks between; a cell over several columns takes their room."""
    out, loose = [], Node("div", {})
    for part in node.parts:
        if isinstance(part, Node) and part.tag == "caption" and _visible(part):
            out += _lines(part)
    loose.parts.extend(_loose(node))  # as browsers do, before the table
    out = _lines(loose) + out
    grid: list[list[tuple[int, int, str]]] = []
    down: list[tuple[int, int, int]] = []  # columns that cells of rows before take: first, end, first row that is free again
    for number, row in enumerate(_rows(node)):
        cells, column, fresh = [], 0, []
        down = [d for d in down if d[2] > number]
        taken = iter(down)
        ahead = next(taken, None)
        for part in row.parts:
            if not (isinstance(part, Node) and part.tag in ("td", "th")):
                if isinstance(part, Node) or part.strip():
                    extra = Node("td", {})
                    extra.parts.append(part)
                    part = extra
                else:
                    continue
            if not _visible(part):
                continue
            while ahead and ahead[0] <= column:
                column = max(column, ahead[1])
                ahead = next(taken, None)
            span, tall = _span(part, "colspan", _MOST_COLUMNS), _span(part, "rowspan", _MOST_ROWS)
            if tall > 1:
                if fresh and fresh[-1][1:] == (column, number + tall):
                    fresh[-1] = (fresh[-1][0], column + span, number + tall)
                else:
                    fresh.append((column, column + span, number + tall))
            cells.append((column, span, " ".join(x.strip() for x in _lines(part) if x.strip())))
            column += span
        if fresh:
            down = sorted(down + fresh)
        grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        for column, span, value in cells:
            if span == 1 and value:
                widths[column] = max(widths.get(column, 0), _width(value))
    used = sorted(widths)
    starts = [0, *itertools.accumulate(widths[c] + 2 for c in used)]
    for cells in grid:
        line, room = [], 0
        for column, _, value in cells:
            if value:
                pad = max(starts[bisect.bisect_left(used, column)] - room, 2 if room else 0)
                line.append(" " * pad + value)
                room += pad + _width(value)
        if line:
            out.append("".join(line).rstrip())
    return out


def _span(cell: Node, name: str, most: int) -> int:
    value = cell.attrs.get(name, "").strip()
    return max(1, min(int(value[:9]), most)) if value.isascii() and value.isdigit() else 1


def render(source: str | None) -> str:
    """Visible text of a page; empty for null or empty source."""
    return "\n".join(_lines(parse(source or "")))


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """Every column of ``pages`` except the source, with text, n_chars, n_lines, text_sha256.

    A null or empty page gives an empty text. Repeated rows stay; columns named
    like the results are replaced, any others stay, whatever their names; an
    empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    results = ("text", "n_chars", "n_lines", "text_sha256")
    names = [c for c in pages.columns if c not in (*results, column)]
    slim = pages.select(F.col(f"`{column}`"), *(F.col(f"`{c}`") for c in names))
    schema = StructType([*(StructField(f.name, f.dataType, True) for f in slim.schema[1:]), StructField("text", StringType()), StructField("n_chars", LongType()), StructField("n_lines", LongType()), StructField("text_sha256", StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [render(x) for x in part.column(0).to_pylist()]
                cols = part.columns[1:] + [
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return slim.mapInArrow(run, schema)
