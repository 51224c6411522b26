"""Layout-aware text of HTML pages: a tree builder with implied tags, visibility rules, and a renderer of blocks, lists and tables."""

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import tidy

#: Elements without content. Fixed values of the HTML standard, as are the other tables here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; that of RAW is not even unescaped.
RAW, ESCAPABLE = frozenset("script style xmp iframe noembed noframes".split()), frozenset("textarea title".split())
#: Elements that are never shown.
HIDDEN = frozenset("head script style template noscript title datalist iframe noembed noframes object audio video canvas area base link meta param source track".split())
#: Start tags that end an open paragraph.
BREAKS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul dd dt".split())
#: Start tag: (open elements that it ends, elements that stop the search).
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
}
#: Blocks with a blank line around them, and blocks on lines of their own.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl blockquote pre table figure fieldset hr".split())
LINED = frozenset("html body address article aside center details dialog div footer form header hgroup main nav search section summary li dt dd figcaption legend caption tr td th thead tbody tfoot optgroup option".split())
#: Start tags that stay in an open head; any other one, and text, ends it.
OF_HEAD = frozenset("base link meta title style script noscript template".split())
#: Columns that all indents of a line take at most, which bounds the text of deeply nested blocks.
INDENT = 40
#: Columns and rows that a cell spans at most, as the HTML standard has it.
COLUMNS, ROWS = 1_000, 65_534
#: Cells wider than this do not widen their column, which bounds the padding of a table; their text stays whole.
ALIGNED = 60
#: Spaces between two cells of a line at most.
GAP = 200

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s=>/][^\s=>/]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_STYLE = re.compile(r"(display|visibility)\s*:\s*([a-z-]+)")
_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.DOTALL)
#: A selector of one element: its name, id and classes.
_SELECTOR = re.compile(r"(\*|[a-z][a-z0-9-]*)?((?:[.#][a-zA-Z_-][\w-]*)*)")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def parse(html: str) -> Node:
    """The page's tree; texts are strings among the children."""
    root = Node("#root", {})
    stack, at, end, opened = [root], 0, len(html), Counter()

    def cut(k: int) -> None:
        opened.subtract(node.tag for node in stack[k:])
        del stack[k:]

    def close(tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        if not any(opened[tag] for tag in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in stop:
                return
            if stack[k].tag in tags:
                cut(k)
                if len(tags) == 1:
                    return

    def push(node: Node) -> None:
        stack[-1].children.append(node)
        stack.append(node)
        opened[node.tag] += 1

    def text(raw: str) -> None:
        if raw:
            if stack[-1].tag == "head" and not raw.isspace():
                cut(len(stack) - 1)
            stack[-1].children.append(unescape(raw) if "&" in raw else raw)

    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        text(html[at:lt])
        after = html[lt + 1 : lt + 2]
        if after == "/":
            gt = html.find(">", lt)
            gt = end if gt < 0 else gt
            name = _NAME.match(html, lt + 2)
            at = gt + 1
            if name:
                tag = name[0].lower()
                # a cell's content does not end what is outside the cell
                stop = frozenset() if tag in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "body", "html") else frozenset(("td", "th", "table"))
                if tag not in stop:
                    close({tag}, stop)
        elif after == "!" or after == "?":
            if html.startswith("<!--", lt):
                stop = html.find("-->", lt + 4)
                at = end if stop < 0 else stop + 3
            else:
                stop = html.find(">", lt)
                at = end if stop < 0 else stop + 1
        elif name := _NAME.match(html, lt + 1):
            tag, at, attributes = name[0].lower(), name.end(), {}
            while at < end and html[at] != ">":
                m = _ATTRIBUTE.match(html, at)
                if not m:
                    at += 1
                    continue
                at = m.end()
                value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
                attributes.setdefault(m[1].lower(), value)
            at += 1
            if stack[-1].tag == "head" and tag not in OF_HEAD:
                cut(len(stack) - 1)
            if tag in BREAKS_P:
                close({"p"}, frozenset(("td", "th", "table", "button", "object")))
            if tag in ENDS:
                close(*ENDS[tag])
            if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                push(Node("tr", {}))
            node = Node(tag, attributes)
            if tag in VOID or tag in RAW or tag in ESCAPABLE:
                stack[-1].children.append(node)
            else:
                push(node)
            if tag in RAW or tag in ESCAPABLE:
                stop = re.compile(rf"</{tag}[\s/>]", re.IGNORECASE).search(html, at)
                inside = html[at : stop.start() if stop else end]
                if tag in ESCAPABLE:
                    node.children.append(unescape(inside))
                elif tag == "style":
                    root.attributes["style"] = root.attributes.get("style", "") + inside + "\n"
                gt = html.find(">", stop.start()) if stop else -1
                at = end if gt < 0 else gt + 1
        else:
            text("<")
            at = lt + 1
    return root


class Sheet:
    """What a page's style sheets say of display and visibility. Selectors are of elements, ids and classes, and chains of them ("div .x", "ul > li"); others, and those of @-rules, are not read."""

    def __init__(self, css: str):
        #: by the name, id or class that a part of a rule asks for: [(rule, place of the part in its chain, tag, names)]
        self.parts: dict[str, list[tuple[int, int, str, frozenset[str]]]] = {}
        #: of each rule: its weight, what stands between its parts, and declarations
        self.rules: list[tuple[tuple[int, int, int, int], list[str], dict[str, str]]] = []
        css, at = _COMMENT.sub(" ", css), 0
        while (brace := css.find("{", at)) >= 0:
            selectors, depth, close = css[at:brace].rpartition(";")[2], 1, brace + 1
            while depth and close < len(css):
                depth += {"{": 1, "}": -1}.get(css[close], 0)
                close += 1
            said, at = {k: v for k, v in _STYLE.findall(css[brace + 1 : close - 1].lower())}, close
            for selector in selectors.split(",") if said and "@" not in selectors else ():
                self._rule(selector.strip(), said)

    def _rule(self, selector: str, said: dict[str, str]) -> None:
        pieces = re.split(r"\s*(>)\s*|\s+", selector)
        chain, between = [_SELECTOR.fullmatch(x) for x in pieces[::2]], [x or " " for x in pieces[1::2]]
        if not all(m and m[0] for m in chain):
            return
        weight = [0, 0, 0]
        for place, m in enumerate(chain):
            names = re.findall(r"[.#][^.#]+", m[2])
            tag, ids = "" if m[1] in (None, "*") else m[1], sum(x[0] == "#" for x in names)
            weight = [weight[0] + ids, weight[1] + len(names) - ids, weight[2] + bool(tag)]
            self.parts.setdefault(names[0] if names else tag or "*", []).append((len(self.rules), place, tag, frozenset(names)))
        self.rules.append(((*weight, len(self.rules)), between, said))

    def of(self, node: Node, above: "Above") -> tuple[dict[str, str], "Above"]:
        """The element's declarations (those of its style attribute before those of the sheets, by weight), and what holds for the elements in it."""
        raw, out, below = node.attributes.get("style"), {}, above
        if self.rules:
            mine = {"*", node.tag, *("." + c for c in node.attributes.get("class", "").split()), "#" + node.attributes.get("id", "").strip()}
            fitting, here = [], set()
            for rule, place, tag, names in (p for name in mine for p in self.parts.get(name, ())):
                weight, between, said = self.rules[rule]
                if names <= mine and tag in ("", node.tag) and (not place or (rule, place - 1) in above[between[place - 1] == ">"]):
                    if place == len(between):
                        fitting.append((weight, said))
                    else:
                        here.add((rule, place))
            for _, said in sorted(fitting, key=lambda r: r[0]):
                out |= said
            if here or above[1]:
                below = above[0] if here <= above[0] else above[0] | here, frozenset(here)
        if raw:
            out |= {k: v for k, v in _STYLE.findall(raw.lower())}
        return out, below


#: Parts of chains, as (rule, place), that an element is anywhere in, and those that it is directly in.
Above = tuple[frozenset[tuple[int, int]], frozenset[tuple[int, int]]]


class Writer:
    """Lines of text with collapsed spaces and blank lines, indents and list markers."""

    def __init__(self):
        self.lines: list[str] = []
        self.held: list[str] = []
        self.space = self.blank = self.broken = False
        self.indents: list[str] = []
        self.marker = ""

    def add(self, text: str) -> None:
        parts = [p for p in _SPACES.split(text) if p]
        if not parts:
            self.space = self.space or bool(text) and bool(self.held)
            return
        if self.held and (self.space or text[0] in " \t\n\r\f"):
            self.held.append(" ")
        self.held.append(" ".join(parts))
        self.space = text[-1] in " \t\n\r\f"

    def raw(self, text: str) -> None:
        for k, line in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if k:
                self.line(keep=True)
            self.held.append(line.expandtabs(8))

    def line(self, keep: bool = False) -> None:
        """End the line; with ``keep``, an empty one too."""
        text, self.held, self.space = "".join(self.held).replace("\xa0", " "), [], False
        if not text.strip() and not keep:
            return
        if self.blank and self.lines and self.lines[-1]:
            self.lines.append("")
        self.blank = False
        lead = self.lead()
        if self.marker and text.strip():
            lead, self.marker = lead[: max(len(lead) - len(self.marker), 0)] + self.marker, ""
        self.lines.append((lead + text).rstrip())

    def lead(self) -> str:
        width = 0
        for k, indent in enumerate(self.indents):
            width += len(indent)
            if width >= INDENT:
                return "".join(self.indents[: k + 1])[:INDENT]
        return "".join(self.indents)

    def wrap(self) -> None:
        """A line break within a block; one right after another leaves an empty line."""
        if not self.held and self.broken:
            self.lines.append("")
        self.broken = self.broken or bool(self.held)
        self.line(keep=bool(self.held))

    def block(self, spaced: bool) -> None:
        self.line()
        self.broken = False
        self.blank = self.blank or spaced

    def done(self) -> list[str]:
        self.line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _laid_out(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table of (cell's lines, columns and rows it spans), cells of a column aligned; a cell keeps its columns in the rows below that it spans."""
    placed: list[list[tuple[int, list[str], int]]] = []
    taken: list[tuple[int, int, int]] = []  # first column, columns and rows left of cells from rows above
    for row in rows:
        column, cells, held, after = 0, [], sorted(taken), []
        for lines, span, down in row:
            while held and held[0][0] < column + span:
                first, width, left = held.pop(0)
                column = max(column, first + width)
                after.append((first, width, left - 1))
            cells.append((column, lines, span))
            if down > 1:
                after.append((column, span, down - 1))
            column += span
        after += [(first, width, left - 1) for first, width, left in held]
        taken = [x for x in after if x[2] > 0]
        placed.append(cells)
    placed = [cells for cells in placed if any(lines for _, lines, _ in cells)]
    widths: dict[int, int] = {}
    for cells in placed:
        for column, lines, span in cells:
            width = max(map(len, lines), default=0)
            if span == 1 and width <= ALIGNED:
                widths[column] = max(widths.get(column, 0), width)
    used = sorted(c for c in widths if widths[c])
    before = dict(zip(used, range(len(used)), strict=True))
    starts = [0]
    for c in used:
        starts.append(starts[-1] + widths[c] + 2)

    def place(column: int) -> int:
        """Where a column's text begins: after all columns before it that have a width."""
        return starts[before[column]] if column in before else starts[bisect_left(used, column)]

    out = []
    for cells in placed:
        for k in range(max(len(lines) for _, lines, _ in cells)):
            line, wide = [], 0
            for column, lines, _ in cells:
                if k < len(lines) and lines[k]:
                    gap = min(max(place(column) - wide, 2 if wide else 0), GAP)
                    line += [" " * gap, lines[k]]
                    wide += gap + len(lines[k])
            out.append("".join(line).rstrip())
    return out


def _marker(item: Node, lists: list[list]) -> str:
    if not lists or lists[-1][0] != "ol":
        return "- "
    counter = lists[-1]
    if re.fullmatch(r"-?\d{1,9}", item.attributes.get("value", "")):
        counter[1] = int(item.attributes["value"])
    shown, counter[1] = counter[1], counter[1] + counter[2]
    return f"{shown}. "


def render(root: Node) -> str:
    """All visible text, one block a line, with blank lines around spaced blocks. Works without recursion, however deep the tree."""
    out, sheet = Writer(), Sheet(root.attributes.get("style", ""))
    writers, tables, lists = [out], [], []
    todo: list = [(root, False, False, True, (frozenset(), frozenset()))]
    while todo:
        node, leaving, pre, shown, above = todo.pop()
        w = writers[-1]
        if isinstance(node, str):
            if shown:
                w.raw(node) if pre else w.add(node)
            continue
        tag = node.tag
        if leaving:
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
            if tag == "li" or tag in ("blockquote", "dd"):
                w.line()
                w.indents.pop()
                w.marker = ""
            if tag in ("td", "th") and tables:
                lines = writers.pop().done()
                span = lambda name, most: min(max(int(n), 1), most) if re.fullmatch(r"\d{1,9}", n := node.attributes.get(name, "1").strip()) else 1  # noqa: B023, E731
                tables[-1][-1].append((lines, span("colspan", COLUMNS), span("rowspan", ROWS)))
                continue
            if tag == "table":
                if w.held:  # text between rows stands before the table
                    w.block(True)
                for line in _laid_out(tables.pop()):
                    w.held.append(line)
                    w.line(keep=True)
            if tag in SPACED or tag in LINED:
                w.block(tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and lists))
            continue
        style, below = sheet.of(node, above) if node is not root else ({}, above)
        if tag in HIDDEN or "hidden" in node.attributes or style.get("display") == "none" or tag == "dialog" and "open" not in node.attributes:
            continue
        if "visibility" in style:
            shown = style["visibility"] not in ("hidden", "collapse")
        if tag == "br":
            w.wrap()
            continue
        if tag in ("img", "input"):
            label = node.attributes.get("value", "") if tag == "input" and node.attributes.get("type", "").lower() in ("submit", "button", "reset") else ""
            if label and shown:
                w.add(f" {unescape(label)} ")
            continue
        pre = pre or tag in ("pre", "textarea", "xmp")
        if tag == "table":
            w.block(True)
            tables.append([[]])
        elif tag == "tr" and tables:
            tables[-1].append([])
        elif tag in ("td", "th") and tables:
            writers.append(Writer())
        elif tag in SPACED or tag in LINED:
            w.block(tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and lists))
        if tag in ("ul", "ol", "menu", "dir"):
            start = node.attributes.get("start", "1")
            back = "reversed" in node.attributes
            first = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
            if back and "start" not in node.attributes:
                first = sum(isinstance(c, Node) and c.tag == "li" for c in node.children)
            lists.append([tag, first, -1 if back else 1])
        elif tag == "li":
            w.marker = _marker(node, lists)
            w.indents.append(" " * len(w.marker))
        elif tag in ("blockquote", "dd"):
            w.indents.append("  ")
        children = node.children
        if tag == "details" and "open" not in node.attributes:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        if tag == "pre" and children and isinstance(children[0], str):
            children = [children[0].removeprefix("\r").removeprefix("\n"), *children[1:]]
        todo.append((node, True, pre, shown, above))
        todo += [(c, False, pre, shown, below) for c in reversed(children)]
    return "\n".join(out.done())


def page_text(html: str | None) -> str:
    return render(parse(html)) if html else ""


def html_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the visible text of each whole page.

    Null and empty pages have the empty text. Pages are rendered one by one, repeated rows alike; no shuffle. What hides: the
    elements of HIDDEN, the hidden attribute, display:none and visibility:hidden in style attributes and in the page's own
    sheets (names, ids, classes and chains of them; a child of an invisible one may be visible again), closed details but for their summary,
    and dialogs that are not open. Indents end at INDENT columns. A column named as the new one is replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [c for c in batch.schema.names if c != text]
            found = [page_text(x.as_py()) for x in batch.column(html)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.string())], [*kept, text])

    out = pages.drop(text)
    return pages.mapInArrow(tidy(run), T.StructType([*out.schema.fields, T.StructField(text, T.StringType())]))
