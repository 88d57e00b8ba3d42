"""Layout-aware rendering of HTML pages to text."""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup; all but the last two are never shown.
RAW = frozenset("script style noembed noframes iframe xmp textarea title".split())
UNSEEN = frozenset("head script style template noscript noembed noframes iframe object audio video canvas svg math datalist title".split())
#: Blocks, and those of them with a blank line around.
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li legend main menu nav ol option p pre search section summary table ul caption tr td th thead tbody tfoot textarea select".split())
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul".split())
LAID = BLOCK - frozenset("td th tr thead tbody tfoot".split())
#: A start tag closes these open elements if it finds them before a boundary (implied end tags).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
CLOSES |= {"tbody": CLOSES["thead"], "tfoot": CLOSES["thead"]}
BOUNDARY = {"li": {"ul", "ol", "menu", "table"}, "dt": {"dl", "table"}, "dd": {"dl", "table"}, "option": {"select"}, "optgroup": {"select"}}
P_CLOSERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: The rest of a tag: a quote mark without a partner is a character like another.
REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+>")
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HIDING = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_SPACE = re.compile(r"[ \t\n\f\r]+")
#: List levels that indent, the width to which table cells are padded, the columns that are aligned, and the blocks
#: within blocks that are laid out on their own; what goes beyond is shown without.
MAX_INDENT, MAX_PAD, MAX_COLUMNS, MAX_FLOWS = 20, 80, 256, 24
#: Parts of a table, whose end tags close what is open in a cell.
PARTS = frozenset("tr td th tbody thead tfoot caption".split())


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(raw: str) -> dict:
    if not raw or raw == "/":
        return {}
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


#: What start tags may close, by kind: the elements closed, and those that are not looked beyond.
KINDS = {"p": (frozenset({"p"}), frozenset({"button", "td", "th", "table", "caption"}))}
KINDS |= {t: (frozenset(x), frozenset(BOUNDARY.get(t, {"table"}))) for t, x in CLOSES.items()}
_MEMBER: dict[str, list[str]] = {}
_BOUND: dict[str, list[str]] = {}
for _kind, (_tags, _ends) in KINDS.items():
    for _t in _tags:
        _MEMBER.setdefault(_t, []).append(_kind)
    for _t in _ends:
        _BOUND.setdefault(_t, []).append(_kind)


class _Open:
    """The open elements, with counts that tell at once whether there is one to close, so that no tag makes the stack be
    searched in vain."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.total: dict[str, int] = {}
        self.scopes: list[dict[str, int]] = [{}]
        self.held = {k: [0] for k in KINDS}

    def push(self, node: Node) -> None:
        self.stack.append(node)
        tag = node.tag
        self.total[tag] = self.total.get(tag, 0) + 1
        if tag == "table":
            self.scopes.append({})
        else:
            scope = self.scopes[-1]
            scope[tag] = scope.get(tag, 0) + 1
        for k in _MEMBER.get(tag, ()):
            self.held[k][-1] += 1
        for k in _BOUND.get(tag, ()):
            self.held[k].append(0)

    def pop(self) -> str:
        tag = self.stack.pop().tag
        self.total[tag] -= 1
        if tag == "table":
            self.scopes.pop()
        else:
            self.scopes[-1][tag] -= 1
        for k in _BOUND.get(tag, ()):
            self.held[k].pop()
        for k in _MEMBER.get(tag, ()):
            self.held[k][-1] -= 1
        return tag

    def end(self, tag: str) -> None:
        """An end tag: closes the nearest such element; outside of the open table only for ``PARTS`` and tables."""
        if (self.total if tag in PARTS or tag == "table" else self.scopes[-1]).get(tag, 0):
            while self.pop() != tag:
                pass

    def imply(self, kind: str) -> None:
        """The end tags that a start tag implies: those of all its kind up to the boundary if these are table cells,
        rows or options, else of the nearest."""
        left = self.held[kind][-1]
        while left:
            tag = self.pop()
            if tag in KINDS[kind][0]:
                left = left - 1 if tag in ("td", "th", "tr", "option") else 0


def parse(page: str) -> Node:
    """The element tree. End tags without a start are ignored, open elements end with an ancestor, and the start tags
    in ``CLOSES`` and ``P_CLOSERS`` imply the end tags that HTML lets an author leave out; rows and cells outside of
    a table body or row are taken as they come. A tag ends at the first ``>`` outside of quotes; from the first tag
    on for which there is none, quotes count for nothing. Time is in proportion to the page, whatever it holds: what
    is not found once is not looked for again."""
    root = Node("html", {})
    opened = _Open(root)
    stack = opened.stack
    at = mark = 0
    quotes = closable = cdata = True

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(unescape(s))

    while True:
        i = page.find("<", mark)
        if i < 0 or not closable:
            text(page[at:])
            return root
        following = page[i + 1 : i + 2]
        if following == "!" or following == "?":
            if page.startswith("<!--", i):
                text(page[at:i])
                stop = page.find("-->", i + 4)
                if stop < 0:
                    return root
                at = mark = stop + 3
                continue
            if cdata and page.startswith("<![CDATA[", i):
                stop = page.find("]]>", i + 9)
                if stop >= 0:
                    text(page[at:i])
                    if stop > i + 9:
                        stack[-1].children.append(page[i + 9 : stop])
                    at = mark = stop + 3
                    continue
                cdata = False
        named = NAME.match(page, i + 2 if following == "/" else i + 1)
        if not named and following not in ("!", "?", "/"):
            mark = i + 1
            continue
        stop = -1
        if named and quotes:
            rest = REST.match(page, named.end())
            stop, quotes = (rest.end() - 1, True) if rest else (-1, False)
        if stop < 0:
            stop = page.find(">", named.end() if named else i + 1)
        if stop < 0:
            closable = False
            continue
        text(page[at:i])
        at = mark = stop + 1
        if not named:
            continue
        tag, inner = named[0].lower(), page[named.end() : stop]
        if following == "/":
            if tag == "p" and not opened.total.get("p"):
                stack[-1].children.append(Node("p", {}))
            opened.end(tag)
            continue
        if tag in ("html", "body"):
            root.attrs.update(_attributes(inner))
            if tag == "body" and stack[-1].tag == "head":
                opened.pop()
            continue
        if stack[-1].tag == "head" and tag not in ("title", "meta", "link", "base", "script", "style", "noscript", "template"):
            opened.pop()
        if tag in P_CLOSERS:
            opened.imply("p")
        if tag in CLOSES:
            opened.imply(tag)
        node = Node(tag, _attributes(inner))
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            stop = end.start() if end else len(page)
            node.children.append(unescape(page[at:stop]) if tag in ("textarea", "title") else page[at:stop])
            at = stop
            if end:
                close = page.find(">", end.end())
                at = close + 1 if close >= 0 else len(page)
            mark = at
        elif tag not in VOID and not (inner.endswith("/") and tag in ("svg", "path")):
            opened.push(node)


def shown(node: Node) -> bool:
    """The visibility rules."""
    a = node.attrs
    if not a:
        return node.tag not in UNSEEN and node.tag != "dialog"
    if node.tag in UNSEEN or "hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
        return False
    return not (node.tag == "dialog" and "open" not in a) and not ("style" in a and _HIDING.search(a["style"]))


class Flow:
    """Lines of text: runs of white space collapse, blocks start lines, spaced blocks keep one blank line between."""

    __slots__ = ("gap", "lines", "parts", "space")

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = self.gap = False

    def text(self, s: str) -> None:
        words = _SPACE.split(s)
        if len(words) > 1 and not words[0]:
            self.space = True
        body = " ".join(w for w in words if w)
        if body:
            if self.space and self.parts:
                self.parts.append(" ")
            self.parts.append(body)
            self.space = len(words) > 1 and not words[-1]

    def end_line(self, force: bool = False) -> None:
        if self.parts or force:
            self._gap()
            self.lines.append("".join(self.parts))
            self.parts = []
        self.space = False

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap = self.gap or spaced

    def _gap(self) -> None:
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = False

    def put(self, lines: list[str]) -> None:
        self.end_line()
        if lines:
            self._gap()
            self.lines += lines

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        if not self.lines or self.lines[0]:
            return self.lines
        return self.lines[next(i for i, x in enumerate(self.lines) if x) :]


def _span(node: Node, name: str, most: int) -> int:
    if not node.attrs:
        return 1
    raw = node.attrs.get(name, "").strip()
    return min(max(int(raw), 1), most) if raw.isascii() and raw.isdigit() and len(raw) < 9 else 1


def aligned(rows: list[list[tuple[int, list[str], int]]]) -> list[str]:
    """Lines of a table: each row is its cells as (column, lines, columns spanned); columns start at the same place
    in all rows, as far as their cells are not wider than ``MAX_PAD``. Cells that span columns do not widen them;
    columns from ``MAX_COLUMNS`` on follow two spaces after the one before."""
    width: dict[int, int] = {}
    for row in rows:
        for c, lines, wide in row:
            if c < MAX_COLUMNS:
                width[c] = max(width.get(c, 0), *(min(len(x), MAX_PAD) if wide == 1 else 1 for x in lines or [""]))
    used = sorted(c for c, w in width.items() if w)
    out: list[str] = []
    for row in rows:
        cells = [(c, lines) for c, lines, _ in row if lines]
        if not cells:
            continue
        if len(used) == 1 and len(cells) == 1:
            out += cells[0][1]
            continue
        last = max(c for c, _ in cells)
        near, beyond = {c: lines for c, lines in cells if c < MAX_COLUMNS}, [lines for c, lines in cells if c >= MAX_COLUMNS]
        columns = [(near.get(c, ()), width[c] if c < last else 0) for c in used[: bisect_right(used, last)]]
        for i in range(max(len(lines) for _, lines in cells)):
            line = [(lines[i] if i < len(lines) else "").ljust(w) for lines, w in columns]
            out.append("  ".join([*line, *(lines[i] for lines in beyond if i < len(lines))]).rstrip())
    return out


class _Table:
    """Rows of cells (column, lines, columns spanned). Of the first ``MAX_COLUMNS`` columns it knows the row up to
    which a cell of an earlier row reaches down; a cell takes the next free column."""

    def __init__(self):
        self.rows: list[list] = []
        self.busy: list[int] = []
        self.next = 0

    def new_row(self) -> None:
        self.rows.append([])
        self.next = 0

    def cell(self, lines: list[str], wide: int, tall: int) -> None:
        if not self.rows:
            self.new_row()
        at, busy, here = self.next, self.busy, len(self.rows)
        while at < len(busy) and busy[at] > here:
            at += 1
        self.rows[-1].append((at, lines, wide))
        self.next = at + wide
        stop = min(self.next, MAX_COLUMNS)
        if tall > 1 and at < stop:
            busy.extend([0] * (stop - len(busy)))
            busy[at:stop] = [here + tall] * (stop - at)


def render(page: str) -> str:
    """All visible text of a page. Iterative, so that deep nesting is no limit; blocks nested deeper than
    ``MAX_FLOWS`` are shown in the block around them."""
    flows, lists, tables, pre = [Flow()], [], [], 0
    work: list[tuple] = [("in", parse(page))]
    while work:
        step, node = work.pop()
        if isinstance(node, str):
            if pre:
                head, *rest = node.split("\n")
                for i, piece in enumerate([head, *rest]):
                    if i:
                        flows[-1].end_line(True)
                    if piece:
                        flows[-1].parts.append(piece.replace("\t", "    "))
            else:
                flows[-1].text(node)
            continue
        tag = node.tag
        if step == "in":
            if not shown(node):
                continue
            if tag == "br":
                flows[-1].end_line(True)
                continue
            if tag == "input" and node.attrs.get("type", "").lower() in ("button", "submit", "reset"):
                flows[-1].text(f" {node.attrs.get('value', '')} ")
                continue
            if tag in LAID:
                flows[-1].block(tag in SPACED and not (tag in ("ul", "ol") and lists))
            out = "out"
            if tag in ("ul", "ol", "menu"):
                raw = node.attrs.get("start", "1")
                lists.append([tag == "ol", int(raw) if raw.lstrip("-").isdecimal() and raw.isascii() and len(raw) < 9 else 1])
            elif tag in ("li", "dd", "blockquote") or tag in ("td", "th") and tables:
                if len(flows) > MAX_FLOWS:
                    out = "past"
                    flows[-1].block(False)
                    if tag == "li":
                        flows[-1].text(_mark(lists))
                else:
                    flows.append(Flow())
            elif tag == "pre":
                pre += 1
            elif tag == "table":
                tables.append(_Table())
            elif tag == "tr" and tables:
                tables[-1].new_row()
            work.append((out, node))
            work.extend(("in", c) for c in reversed(node.children))
            continue
        if tag in ("ul", "ol", "menu"):
            lists.pop()
        elif step == "past":
            flows[-1].block(False)
        elif tag in ("li", "dd", "blockquote"):
            lines = flows.pop().done()
            mark = _mark(lists) if tag == "li" else "  "
            deep = len(lists) > MAX_INDENT
            flows[-1].put([(mark if i == 0 and tag == "li" else "" if deep else " " * len(mark)) + x if x else x for i, x in enumerate(lines)])
        elif tag == "pre":
            pre -= 1
        elif tag in ("td", "th") and tables:
            tables[-1].cell(flows.pop().done(), _span(node, "colspan", 1000), _span(node, "rowspan", 65534))
        elif tag == "table":
            flows[-1].put(aligned(tables.pop().rows))
        if tag in LAID:
            flows[-1].block(tag in SPACED and not (tag in ("ul", "ol") and lists))
    return "\n".join(flows[0].done())


def _mark(lists: list) -> str:
    """The mark of the next item of the open list."""
    ordered = lists[-1] if lists else [False, 1]
    ordered[1] += 1
    return f"{ordered[1] - 1}. " if ordered[0] else "- "


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and text, the rendered visible text, for each row of ``pages``. A null or empty page has an empty
    text; text outside of any tag is visible; whatever is no tag is text. A very long page is rendered whole, in time
    in proportion to its length. Rows are rendered one by one, without a shuffle: repeated rows and ids stay, a null
    id is kept, no rows give no rows, and other columns are not read."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([render(h.as_py() or "") for h in part.column(1)], pa.string())], ["page_id", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, f"page_id {kind}, text string")
