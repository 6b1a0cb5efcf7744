"""Layout-aware text of web pages (operator 6).

A tree builder with implied tags turns markup into elements, visibility rules drop what a browser does not show,
and the rest is laid out as text: blocks on lines of their own, paragraphs apart by an empty line, list items with
markers and indentation, table cells padded to their columns. No visible text is dropped.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Generator, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head title script style template noscript iframe noembed noframes audio video canvas object datalist".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre xmp figure table hr".split())
BLOCKS = APART | frozenset(
    "html body div section article aside nav header footer main address center details summary dialog fieldset form legend figcaption hgroup li dt dd caption thead tbody tfoot tr option optgroup search".split()
)
CLOSES_P = BLOCKS - frozenset("html body caption thead tbody tfoot tr option optgroup legend".split())
ROWS = frozenset("thead tbody tfoot tr".split())
#: A start tag ends open elements of these names, up to an element of the second set.
ENDS = {
    "li": ("li", "ul ol menu dir table"),
    "dt": ("dt dd", "dl table"),
    "dd": ("dt dd", "dl table"),
    "option": ("option", "select datalist optgroup"),
    "optgroup": ("option optgroup", "select"),
    "tr": ("td th tr caption colgroup", "table"),
    "td": ("td th caption colgroup", "tr table"),
    "th": ("td th caption colgroup", "tr table"),
    "thead": ("td th tr thead tbody tfoot caption colgroup", "table"),
    "tbody": ("td th tr thead tbody tfoot caption colgroup", "table"),
    "tfoot": ("td th tr thead tbody tfoot caption colgroup", "table"),
    "caption": ("caption colgroup", "table"),
    "rt": ("rt rp", "ruby"),
    "rp": ("rt rp", "ruby"),
}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}
SCOPE = frozenset("table td th caption html template".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"'=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*+)>")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>\x00]*)([^>]*)>")
_NO_TEXT = re.compile(r"<[!?/]")
_NAME = re.compile(r"</?[a-zA-Z]")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_HINT = re.compile(r"hidden|reversed|display|visibility|span|start|value|open|type|class|id", re.I)
#: One element's name, classes and ids, without anything before or after it.
_SIMPLE = re.compile(r"(?:[a-z][\w-]*)?(?:[.#][a-z_-][\w-]*)*\Z")
_NAMES = re.compile(r"[.#]?[a-z_-][\w-]*")
#: Width, in pixels, of the screen that conditions of style sheets are held against.
SCREEN = 1280
#: Cells that have others to their right are broken at spaces into lines of this length, so that columns stay aligned.
ALIGN = 64


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def _attributes(source: str) -> dict[str, str]:
    if not source or not _HINT.search(source):
        return {}
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
    return out


def tree(source: str) -> Node:
    root = Node("html", {})
    stack = [root]
    # Where in the stack the open elements of a name are, and those of the sets that end a search: nothing walks the stack.
    places: defaultdict[str, list[int]] = defaultdict(list)
    scopes, blocks = [0], [0]

    def push(node: Node) -> None:
        for found in (places[node.tag], *[scopes] * (node.tag in SCOPE), *[blocks] * (node.tag in BLOCKS)):
            found.append(len(stack))
        stack.append(node)

    def cut(low: int) -> None:
        """End all elements from a place of the stack on."""
        while len(stack) > low:
            tag = stack.pop().tag
            places[tag].pop()
            if tag in SCOPE:
                scopes.pop()
            if tag in BLOCKS:
                blocks.pop()

    def close(names: frozenset, stop: frozenset) -> None:
        """End the outermost open element of these names below the nearest stop."""
        if not any(map(places.get, names)):
            return
        least = max((places[t][-1] for t in stop if places.get(t)), default=0)
        found = [places[t][i] for t in names if places.get(t) and (i := bisect_right(places[t], least)) < len(places[t])]
        if found:
            cut(min(found))

    def opened(tag: str, attributes: dict[str, str]) -> None:
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag not in VOID:
            push(node)

    at, end, last, loose = 0, len(source), source.rfind(">"), False

    def text(words: str) -> None:
        if words:
            stack[-1].children.append(html.unescape(words) if "&" in words else words)

    while at < end:
        cut_at = source.find("<", at)
        if cut_at < 0 or cut_at > last:  # no tag ends any more
            unseen = _NO_TEXT.search(source, at)
            text(source[at : unseen.start() if unseen else end])
            break
        text(source[at:cut_at])
        at = cut_at
        if source.startswith("<!--", at):
            close_at = source.find("-->", at + 4)
            at = close_at + 3 if close_at >= 0 else end
            continue
        if not _NAME.match(source, at):
            if source[at + 1 : at + 2] in ("!", "?", "/"):
                at = source.find(">", at) + 1
            else:
                text("<")
                at += 1
            continue
        m = (_LOOSE_TAG if loose else _TAG).match(source, at)
        if m is None:  # quotes that never close: from here on a tag ends at the next >, so the rest is read once more at most
            loose = True
            m = _LOOSE_TAG.match(source, at)
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not places.get("p"):
                stack[-1].children.append(Node("p", {}))
            elif tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif tag not in ("html", "body"):
                low = places[tag][-1] if places.get(tag) else 0
                if low and (tag in SCOPE | ROWS or scopes[-1] <= low) and (tag in BLOCKS | SCOPE or blocks[-1] <= low):
                    cut(low)
            continue
        if tag in ("html", "body"):
            stack[0].attributes.update(_attributes(m[3]))
            cut(1)
            continue
        if stack[-1].tag == "head" and tag not in UNSEEN | {"meta", "link", "base"}:
            cut(len(stack) - 1)
        if tag in CLOSES_P:
            close(frozenset({"p"}), SCOPE)
        if tag in ENDS:
            close(*ENDS[tag])
        if tag in ("td", "th") and stack[-1].tag != "tr" and places.get("table"):
            opened("tr", {})
        opened(tag, _attributes(m[3]))
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
            raw = source[at : stop.start() if stop else end]
            stack[-1].children.append(html.unescape(raw) if tag == "textarea" else raw)
            at = stop.end() if stop else end
            if stack[-1].tag == tag:
                cut(len(stack) - 1)
    return root


class Page:
    """Lines of text; breaks are owed until there is text to set apart."""

    def __init__(self):
        self.out: list[str] = []
        self.owed, self.space = 0, False
        #: Parts of the indentation, joined when there is text; and how many of them stand before a list item's marker.
        self.indent: list[str] = []
        self.first: tuple[int, str] | None = None

    def lines(self, n: int) -> None:
        self.owed, self.space = max(self.owed, n), False

    def text(self, words: str, keep: bool = False) -> None:
        if not keep:
            flat = _SPACE.sub(" ", words)
            if flat == " " or not flat:
                self.space = self.space or bool(flat)
                return
            head, body = flat[0] == " ", flat.strip(" ")
        else:
            head, body = False, words
        if self.owed or not self.out:
            if self.out:
                self.out.append("\n" * self.owed)
            self.out.append("".join(self.indent) if self.first is None else "".join(self.indent[: self.first[0]]) + self.first[1])
            self.owed, self.first = 0, None
        elif head or self.space:
            self.out.append(" ")
        self.out.append(body.replace("\n", "\n" + "".join(self.indent)) if keep and "\n" in body else body)
        self.space = not keep and flat[-1] == " "

    def value(self) -> str:
        return "".join(self.out)


Hidden = dict[str, list[frozenset[str]]]


def _applies(prelude: str) -> bool:
    """Whether the rules in a block of a style sheet hold on a screen: those of media that a screen of SCREEN is, of support tests and of layers."""
    kind, _, condition = prelude.strip().partition(" ")
    if kind in ("@supports", "@layer"):
        return True
    if kind != "@media":
        return False

    def holds(query: str) -> bool:
        bounds = re.findall(r"\((min|max)-width:\s*(\d+)(?:px)?\)", query)
        other = re.sub(r"\((?:min|max)-width:\s*\d+(?:px)?\)|\b(?:only|screen|all|and)\b", "", query).strip()
        return not other and all(SCREEN >= int(n) if side == "min" else SCREEN <= int(n) for side, n in bounds)

    return any(map(holds, condition.split(",")))


def _rules(sheet: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the rules that hold; braces are followed, whatever their depth."""
    open_, at, skipped = [], 0, 0  # per open block whether its rules count; where the text since the last brace begins
    for brace in re.finditer(r"[{}]", sheet):
        between, at = sheet[at : brace.start()], brace.end()
        if brace[0] == "{":
            prelude = between.rpartition(";")[2].strip()
            open_.append(prelude)
            skipped += prelude.startswith("@") and not _applies(prelude)
        elif open_:
            prelude = open_.pop()
            if prelude.startswith("@"):
                skipped -= not _applies(prelude)
            elif not skipped:
                yield prelude, between


def hiding(root: Node) -> Hidden:
    """What style sheets of the page hide by `display: none`: by one of its names, each set of names (element, .class, #id)
    that one element must have. Selectors of more than one element, of states and of attributes are not read."""
    found: set[frozenset[str]] = set()
    nodes = [root]
    while nodes:
        node = nodes.pop()
        if node.tag == "style":
            sheet = re.sub(r"/\*.*?(?:\*/|\Z)", "", "".join(c for c in node.children if isinstance(c, str)), flags=re.S).lower()
            sheet = re.sub(r"\"[^\"\n]*\"|'[^'\n]*'", "''", sheet)
            for selectors, body in _rules(sheet) if "none" in sheet else ():
                if re.search(r"(?:^|;)display:none", re.sub(r"\s+", "", body)):
                    found.update(frozenset(_NAMES.findall(s)) for s in map(str.strip, selectors.split(",")) if s and _SIMPLE.match(s))
        nodes += [c for c in node.children if not isinstance(c, str)]
    out: Hidden = defaultdict(list)
    for names in found - {frozenset({"html"}), frozenset({"body"})}:
        out[max(names)].append(names)
    return dict(out)


def _shown(node: Node, seen: bool, hidden: Hidden) -> tuple[bool, bool]:
    """(whether the element makes a box, whether text in it is visible)."""
    a = node.attributes
    if node.tag in UNSEEN or "hidden" in a and a["hidden"].lower() != "until-found" or node.tag == "dialog" and "open" not in a:
        return False, False
    style = re.sub(r"\s+|/\*.*?\*/", "", a["style"].lower()) if "style" in a else ""
    if re.search(r"(?:^|;)display:none", style):
        return False, False
    if hidden and "display:" not in style:
        names = {node.tag, "#" + a.get("id", "").lower(), *("." + c for c in a.get("class", "").lower().split())}
        if any(own <= names for n in names if n in hidden for own in hidden[n]):
            return False, False
    if m := re.search(r"(?:^|;)visibility:(hidden|collapse|visible)", style):
        seen = m[1] == "visible"
    return True, seen


def _number(text: str | None, other: int) -> int:
    m = re.match(r"\s*(-?\d{1,9})", text or "")
    return int(m[1]) if m else other


def _run(step: Generator) -> None:
    """Run a step and the steps that it yields, each to its end before it goes on: as deep as pages are, without recursion."""
    steps, got = [step], None
    while steps:
        try:
            steps.append(steps[-1].send(got))
            got = None
        except StopIteration as end:
            steps.pop()
            got = end.value


def _broken(line: str) -> list[str]:
    """A line in parts of up to ALIGN, broken at spaces; a longer word is a part of its own."""
    if len(line) <= ALIGN:
        return [line]
    parts, size = [[]], -1
    for word in line.split(" "):
        if size + 1 + len(word) > ALIGN and parts[-1]:
            parts.append([])
            size = -1
        parts[-1].append(word)
        size += 1 + len(word)
    return [" ".join(p) for p in parts]


class Grid:
    """Rows of a table as (column, lines of a cell); cells that span rows keep their columns."""

    def __init__(self):
        self.rows: list[list[tuple[int, list[str]]]] = []
        self.taken, self.until = 0, defaultdict(int)  # columns taken by cells from above, as bits; and by the last row that they reach

    def begin(self) -> None:
        self.taken &= ~self.until.pop(len(self.rows) - 1, 0)
        self.rows.append([])
        self.column = 0

    def add(self, value: str, columns: int = 1, rows: int = 1) -> None:
        if self.taken:
            free = ~self.taken >> self.column
            self.column += (free & -free).bit_length() - 1
        if value:
            self.rows[-1].append((self.column, value.split("\n")))
        if rows != 1:
            bits = ((1 << columns) - 1) << self.column
            self.taken |= bits
            self.until[len(self.rows) + rows - 2 if rows else -1] |= bits
        self.column += columns

    def end_group(self) -> None:
        self.taken, self.until = 0, defaultdict(int)

    def lines(self) -> Iterator[str]:
        """Cells side by side, each line of a row on a line, columns apart by two spaces; columns without text take no room."""
        width: defaultdict[int, int] = defaultdict(int)
        for row in self.rows:
            row[:-1] = [(column, [part for line in value for part in _broken(line)]) for column, value in row[:-1]]
        for column, value in (cell for row in self.rows for cell in row):
            width[column] = max(width[column], *(len(v) for v in value if len(v) <= ALIGN), 0)
        left, at = {}, 0
        for column in sorted(width):
            left[column] = at
            at += width[column] + 2
        for row in self.rows:
            for i in range(max((len(value) for _, value in row), default=0)):
                out, size = [], 0
                for column, value in row:
                    if i < len(value) and value[i]:
                        gap = max(left[column] - size, 2 if size else 0)
                        out += [" " * gap, value[i]]
                        size += gap + len(value[i])
                yield "".join(out)


def _cells(node: Node, page: Page, seen: bool, hidden: Hidden, grid: Grid) -> Generator:
    """Put the rows of a table into the grid; what stands in it outside of rows is laid out before it. A step of _run."""
    for child in node.children:
        if isinstance(child, str):
            if child.strip() and seen:
                page.text(child)
            continue
        box, visible = _shown(child, seen, hidden)
        if not box or child.tag in ("col", "colgroup"):
            continue
        if child.tag in ("thead", "tbody", "tfoot"):
            yield _cells(child, page, visible, hidden, grid)
            grid.end_group()
        elif child.tag == "tr":
            grid.begin()
            for cell in child.children:
                if isinstance(cell, str):
                    if cell.strip() and visible:
                        grid.add(_SPACE.sub(" ", cell).strip(" "))
                    continue
                cell_box, cell_seen = _shown(cell, visible, hidden)
                if cell_box:
                    inner = Page()
                    yield _lay(cell, inner, cell_seen, False, 0, hidden)
                    value = re.sub(r"\s*\n", "\n", inner.value()).strip("\n").rstrip()
                    grid.add(value, min(max(_number(cell.attributes.get("colspan"), 1), 1), 1000), min(max(_number(cell.attributes.get("rowspan"), 1), 0), 65534))
        else:
            page.lines(1)
            yield _lay(child, page, visible, False, 0, hidden)
            page.lines(1)


def _lay(node: Node, page: Page, seen: bool, pre: bool, depth: int, hidden: Hidden) -> Generator:
    """Lay out what is in an element. A step of _run."""
    pre = pre or node.tag in ("pre", "xmp", "textarea")
    count, step = 0, 1
    if node.tag == "ol":
        step = -1 if "reversed" in node.attributes else 1
        count = _number(node.attributes.get("start"), 1 if step > 0 else sum(not isinstance(c, str) and c.tag == "li" for c in node.children))
    closed = node.tag == "details" and "open" not in node.attributes
    for child in node.children:
        if isinstance(child, str):
            if seen and not closed:
                page.text(child.removeprefix("\n") if pre and child is node.children[0] else child, keep=pre and bool(child.strip("\n")))
            continue
        tag = child.tag
        if closed and tag != "summary":
            continue
        if tag == "br":
            page.owed, page.space = (page.owed + 1 if page.owed < 2 else 2), False
            continue
        box, visible = _shown(child, seen, hidden)
        if not box:
            continue
        gap = 2 if tag in APART and not (tag in ("ul", "ol") and depth) else 1 if tag in BLOCKS else 0
        if gap:
            page.lines(gap)
        if tag == "table":
            grid = Grid()
            yield _cells(child, page, visible, hidden, grid)
            for line in grid.lines():
                if line:
                    page.lines(1 if page.owed < 2 else 2)
                    page.text(line, keep=True)
        elif tag == "li":
            if node.tag == "ol":
                count = _number(child.attributes.get("value"), count)
            mark = f"{count}. " if node.tag == "ol" else "- "
            count += step
            page.first = len(page.indent), mark
            page.indent.append(" " * len(mark))
            yield _lay(child, page, visible, pre, depth + 1, hidden)
            page.first = None
            page.indent.pop()
        else:
            inner = tag in ("blockquote", "dd")
            if inner:
                page.indent.append("  ")
            if tag in ("td", "th"):
                page.space = True
            yield _lay(child, page, visible, pre, depth + (tag in ("ul", "ol")), hidden)
            if inner:
                page.indent.pop()
        if gap:
            page.lines(gap)


def render(source: str | None) -> str:
    """The visible text of a page; empty for null."""
    if not source:
        return ""
    page, root = Page(), tree(source)
    hidden = hiding(root) if "<style" in source.lower() else {}
    box, seen = _shown(root, True, hidden)
    if box:
        _run(_lay(root, page, seen, False, 0, hidden))
    return page.value()


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text, n_chars per row, in no fixed order. Null or empty html gives an empty text; equal rows give equal
    rows, a null id stays null; pages of any length and depth are rendered whole; other columns are not read."""

    def to_text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [render(h if isinstance(h, str) else None) for h in batch["h"]]
            yield pd.DataFrame({"page_id": batch["i"].astype("Int64"), "text": text, "n_chars": [len(t) for t in text]})

    return pages.select(F.col(id_col).cast("long").alias("i"), F.col(html_col).alias("h")).mapInPandas(to_text, "page_id long, text string, n_chars long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.read(spark, sf_dir, "pages"))
