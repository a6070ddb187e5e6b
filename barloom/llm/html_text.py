"""Layout-aware text of HTML pages.

A tokenizer and a tree builder with implied tags make a tree of any input; a renderer walks
it and writes what a reader would see: hidden elements are left out, white space collapses
except where it is preformatted, blocks stand on lines of their own with blank lines round
paragraphs, list items have their markers and indents, and table cells line up in columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from barloom.session import ship_package

# Fixed values from the HTML standard: element classes by their names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
RAW_WITH_REFS = frozenset("title textarea".split())
HIDDEN = frozenset("head title script style template noscript noembed noframes iframe object video audio canvas datalist area param rp meta link base annotation annotation-xml".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre figure table menu dir fieldset form hr".split())
BLOCKS = PARAGRAPHS | frozenset("html body div section article aside header footer main nav address center details summary dialog figcaption legend li dt dd tr caption hgroup search optgroup option".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dt dd".split())
SCOPE = frozenset("html body table td th caption button object template".split())
SVG_UNSEEN = frozenset("desc metadata defs symbol clippath mask marker pattern".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Elements nested deeper become children of the last that fits, as browsers do.
DEPTH = 200
#: Cells wider than this do not widen their column.
WIDEST = 60
#: Largest colspan, as in the standard.
SPAN = 1000
#: Pixels of the screen that media queries are asked about.
SCREEN = (1280, 720)

_TOKEN = re.compile(r"<!--(?P<comment>.*?)(?:-->|--!>|\Z)|<[!?/](?=[^a-zA-Z])[^>]*(?:>|\Z)|<!(?P<doctype>[^>]*)(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+(?:\s+[a-z-]+)*)\s*(!\s*important)?\s*(?=;|\Z)", re.I)
_SHOWN = frozenset("block inline inline-block flex inline-flex grid inline-grid table inline-table table-row table-cell table-row-group table-header-group table-footer-group table-column table-column-group table-caption list-item contents flow-root flow ruby ruby-base ruby-text run-in math initial inherit unset -webkit-box -webkit-flex -ms-flexbox".split())
_FEATURE = re.compile(r"\(\s*(min|max)-(width|height)\s*:\s*([\d.]+)(px|em|rem)?\s*\)\Z", re.I)
_UNSEEN = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse)\b", re.I)
_SEEN = re.compile(r"(?:^|;)\s*visibility\s*:\s*visible\b", re.I)
_SELECTOR = re.compile(r"(\*|[a-z][a-z0-9-]*)?((?:[.#][\w-]+)*)\Z", re.I)


def _display(declarations: str) -> list[tuple[bool, bool]]:
    """Whether each valid ``display`` is important and whether it is none, in order."""
    out = []
    for m in _DISPLAY.finditer(declarations):
        value = m[1].lower().split()
        if value == ["none"] or all(v in _SHOWN for v in value):
            out.append((bool(m[2]), value == ["none"]))
    return out


def _on_screen(queries: str) -> bool:
    """Whether a list of media queries matches a screen of SCREEN; features other than its sizes do not."""

    def one(query: str) -> bool:
        words = query.strip().lower()
        turned = words.startswith("not ")
        words = re.sub(r"^(not|only)\s+", "", words)
        met = True
        for part in re.split(r"\s+and\s+", words):
            m = _FEATURE.match(part.strip())
            if m:
                size = float(m[3].strip(".") or 0) * (1 if m[4] in (None, "px") else 16)
                have = SCREEN[m[2] == "height"]
                met = met and (have >= size if m[1] == "min" else have <= size)
            else:
                met = met and part.strip() in ("", "all", "screen", "(orientation: landscape)", "(orientation:landscape)")
        return met != turned

    return any(one(q) for q in queries.split(","))


def _rules(css: str) -> Iterator[tuple[str, str]]:
    """Selectors and declarations of the rules that hold on a screen, in order."""
    at, n = 0, len(css)
    while at < n:
        brace = css.find("{", at)
        if brace < 0:
            return
        head = css[at:brace]
        depth, to = 1, brace + 1
        for m in re.compile(r"[{}]").finditer(css, to):
            depth += 1 if m[0] == "{" else -1
            to = m.end()
            if not depth:
                break
        else:
            to = n + 1
        body = css[brace + 1 : to - 1]
        at = to
        head = head.rpartition(";")[2].rpartition("}")[2].strip()
        if not head.startswith("@"):
            yield head, re.sub(r"[^;{}]*\{[^{}]*\}", "", body)
            continue
        name, _, rest = head[1:].partition(" ") if "(" not in head.split(" ")[0] else (head[1 : head.index("(")], "", head[head.index("(") :])
        name = name.lower()
        if (name == "media" and _on_screen(rest)) or name == "layer" or (name == "supports" and not rest.strip().lower().startswith("not")):
            yield from _rules(body)


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if text and not text.isspace():
        for m in _ATTR.finditer(text):
            out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


class Builder:
    """Tree of a page; ``styles`` gathers the text of style elements."""

    def __init__(self, html: str) -> None:
        self.root = Node("html", {})
        self.open = [self.root]
        self.beyond = 0
        self.styles: list[str] = []
        at, end = 0, len(html)
        while at < end:
            lt = html.find("<", at)
            if lt < 0:
                self.text(html[at:])
                break
            if lt > at:
                self.text(html[at:lt])
            m = _TOKEN.match(html, lt)
            if m is None:
                self.text("<")
                at = lt + 1
                continue
            at = m.end()
            if m["tag"] is None:
                continue
            tag = m["tag"].lower()
            if m["end"]:
                self.close(tag)
            else:
                if m["attrs"].endswith("/") and tag not in ("svg", "math") and self.foreign():
                    self.open[-1].children.append(Node(tag, _attributes(m["attrs"])))
                    continue
                self.start(tag, _attributes(m["attrs"]))
                if tag in RAW or tag in RAW_WITH_REFS:
                    stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                    body = html[at : stop.start() if stop else end]
                    at = stop.end() if stop else end
                    if tag == "style":
                        self.styles.append(body)
                    self.open[-1].children.append(unescape(body) if tag in RAW_WITH_REFS else body)
                    self.pop()

    def foreign(self) -> bool:
        """Whether a drawing or formula is open, where a tag may close itself."""
        return any(node.tag in ("svg", "math") for node in self.open)

    def text(self, s: str) -> None:
        if "&" in s:
            s = unescape(s)
        at = self.open[-1]
        if at.tag in ("table", "tbody", "thead", "tfoot", "tr") and not s.isspace():
            self.foster(s)
        else:
            at.children.append(s)

    def foster(self, child: object) -> None:
        """What may not stand between table parts goes before the table."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == "table":
                siblings = self.open[i - 1].children
                siblings.insert(len(siblings) - 1, child)
                return
        self.open[-1].children.append(child)

    def push(self, tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if len(self.open) < DEPTH:
            self.open.append(node)
        else:
            self.beyond += 1

    def pop(self) -> Node | None:
        if self.beyond:
            self.beyond -= 1
            return None
        return self.open.pop() if len(self.open) > 1 else None

    def close_to(self, tags: frozenset[str], stop: frozenset[str] = SCOPE) -> bool:
        """Close up to and with the nearest open element in ``tags`` that no element in ``stop`` hides."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                self.beyond = 0
                return True
            if self.open[i].tag in stop:
                return False
        return False

    def back_to(self, tags: frozenset[str]) -> None:
        """Close what is open inside the nearest element in ``tags``."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i + 1 :]
                self.beyond = 0
                return

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("html", "body"):
            if tag == "body":
                self.close_to(frozenset({"head"}))
            target = self.root
            for k, v in attrs.items():
                target.attrs.setdefault(k, v)
            return
        if self.open[-1].tag == "head" and tag not in ("meta", "link", "base", "title", "style", "script", "noscript", "template"):
            self.pop()
        if tag in CLOSES_P:
            self.close_to(frozenset({"p"}), SCOPE)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.pop()
        if tag == "li":
            self.close_to(frozenset({"li"}), SCOPE | {"ul", "ol", "menu", "dir"})
        elif tag in ("dt", "dd"):
            self.close_to(frozenset({"dt", "dd"}), SCOPE | {"dl"})
        elif tag in ("option", "optgroup"):
            self.close_to(frozenset({"option"}))
        elif tag in ("rt", "rp"):
            self.close_to(frozenset({"rt", "rp"}))
        elif tag in ("td", "th"):
            self.back_to(frozenset({"tr", "table", "tbody", "thead", "tfoot"}))
            if self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
                self.push("tr", {})
        elif tag == "tr":
            self.back_to(frozenset({"table", "tbody", "thead", "tfoot"}))
        elif tag in ("tbody", "thead", "tfoot", "caption", "colgroup"):
            self.back_to(frozenset({"table"}))
        elif self.open[-1].tag in ("table", "tbody", "thead", "tfoot", "tr") and tag not in ("col", "script", "style", "template", "input", "form"):
            # an element between table parts stands before the table
            node = Node(tag, attrs)
            self.foster(node)
            if tag not in VOID:
                self.open.append(node)
            return
        if tag in VOID:
            self.open[-1].children.append(Node(tag, attrs))
        else:
            self.push(tag, attrs)

    def close(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].children.append(Node("br", {}))
        elif tag == "p":
            if not self.close_to(frozenset({"p"})):
                self.open[-1].children.append(Node("p", {}))
        elif tag in HEADINGS:
            self.close_to(HEADINGS)
        elif tag in ("table", "td", "th", "caption", "button", "object", "template"):
            self.close_to(frozenset({tag}), frozenset({"table"}) if tag != "table" else frozenset())
        elif tag in ("tr", "tbody", "thead", "tfoot"):
            self.close_to(frozenset({tag}), frozenset({"table"}))
        elif tag == "li":
            self.close_to(frozenset({"li"}), SCOPE | {"ul", "ol"})
        elif tag not in ("html", "body"):
            if self.beyond:
                self.beyond -= 1
            else:
                self.close_to(frozenset({tag}))


class Page:
    """Lines of rendered text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = 0
        self.space = False

    def text(self, s: str) -> None:
        collapsed = _SPACE.sub(" ", s)
        if not collapsed:
            return
        if collapsed[0] == " ":
            self.space = True
            collapsed = collapsed[1:]
            if not collapsed:
                return
        if self.space and self.inline:
            self.inline.append(" ")
        self.space = collapsed[-1] == " "
        self.inline.append(collapsed[:-1] if self.space else collapsed)

    def preformatted(self, s: str) -> None:
        first, *rest = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.inline.append(first)
        for line in rest:
            self.newline()
            self.inline.append(line)

    def newline(self) -> None:
        """End the line even if it is empty."""
        self.put("".join(self.inline))
        self.inline, self.space = [], False

    def end(self, gap: int) -> None:
        """End the line if it has text; ask for ``gap`` line breaks before what comes next."""
        if self.inline:
            self.newline()
        self.space = False
        self.gap = max(self.gap, gap)

    def put(self, line: str) -> None:
        if self.gap > 1 and self.lines:
            self.lines.append("")
        self.gap = 0
        self.lines.append(line.rstrip())

    def finished(self) -> list[str]:
        self.end(0)
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        start = 0
        while start < len(lines) and not lines[start]:
            start += 1
        return lines[start:]


class Renderer:
    def __init__(self, styles: list[str]) -> None:
        #: By tag, class or id that a selector needs: (weight, order), its other needs, and whether display is none.
        self.rules: dict[str, list[tuple[tuple, str, frozenset[str], bool]]] = {}
        self.lists = 0
        order = 0
        for css in styles:
            for selectors, body in _rules(re.sub(r"/\*.*?(\*/|\Z)|<!--|-->", "", css, flags=re.S)):
                for important, none in _display(body):
                    order += 1
                    for s in selectors.split(","):
                        m = _SELECTOR.match(s.strip())
                        if m and m[0]:
                            tag, marks = (m[1] or "*").lower(), re.findall(r"[.#][\w-]+", m[2])
                            ids = sum(k[0] == "#" for k in marks)
                            weight = (important, False, ids, len(marks) - ids, tag != "*", order)
                            self.rules.setdefault(marks[0] if marks else tag, []).append((weight, tag, frozenset(marks), none))

    def hidden(self, node: Node) -> bool:
        """Whether the element is not displayed, with all it holds: the declaration of most weight decides, the last of equal ones."""
        tag, attrs = node.tag, node.attrs
        if tag in HIDDEN or (tag == "input" and attrs.get("type", "").lower() == "hidden"):
            return True
        best, none = None, "hidden" in attrs or (tag == "dialog" and "open" not in attrs)
        if "style" in attrs:
            for important, value in _display(attrs["style"]):
                weight = (important, True, 0, 0, False, 0)
                if best is None or weight >= best:
                    best, none = weight, value
        if self.rules:
            marks = {f".{c}" for c in attrs.get("class", "").split()} | ({f"#{attrs['id']}"} if "id" in attrs else set())
            for key in (tag, "*", *marks):
                for weight, of, needs, value in self.rules.get(key, ()):
                    if (of == "*" or of == tag) and needs <= marks and (best is None or weight >= best):
                        best, none = weight, value
        return none

    def drawing(self, node: Node, page: Page, seen: bool) -> None:
        """Labels of a drawing, set apart by spaces; other text in it is not shown."""
        for child in node.children:
            if isinstance(child, str) or child.tag in SVG_UNSEEN or self.hidden(child):
                continue
            style = child.attrs.get("style", "")
            here = bool(_SEEN.search(style)) or (seen and not _UNSEEN.search(style))
            if child.tag in ("text", "foreignobject"):
                page.text(" ")
                self.walk(child, page, False, here)
                page.text(" ")
            else:
                self.drawing(child, page, here)

    def walk(self, node: Node, page: Page, pre: bool, seen: bool) -> None:
        for child in node.children:
            if isinstance(child, str):
                if seen:
                    page.preformatted(child) if pre else page.text(child)
            elif not self.hidden(child):
                self.element(child, page, pre, seen)

    def element(self, node: Node, page: Page, pre: bool, seen: bool) -> None:
        tag = node.tag
        style = node.attrs.get("style", "") if node.attrs else ""
        if style:
            seen = bool(_SEEN.search(style)) or (seen and not _UNSEEN.search(style))
        if tag == "br":
            page.newline()
            return
        if tag == "wbr":
            return
        if tag == "input":
            if seen and node.attrs.get("type", "").lower() in ("submit", "button", "reset"):
                page.text(node.attrs.get("value", ""))
            return
        if tag == "svg":
            self.drawing(node, page, seen)
            return
        block = tag in BLOCKS
        listing = tag in ("ul", "ol", "menu", "dir")
        gap = 2 if tag in PARAGRAPHS and not (listing and self.lists) else 1
        if block:
            page.end(gap)
        if tag == "table":
            self.table(node, page, seen)
        elif listing:
            self.lists += 1
            self.items(node, page, pre, seen)
            self.lists -= 1
        elif tag in ("blockquote", "dd"):
            self.indented(node, page, "  ", "  ", pre, seen)
        elif tag == "details" and "open" not in node.attrs:
            for child in node.children:
                if isinstance(child, Node) and child.tag == "summary":
                    self.element(child, page, pre, seen)
                    break
        elif tag in ("option", "optgroup") and node.attrs.get("label"):
            if seen:
                page.text(node.attrs["label"])
            if tag == "optgroup":
                page.end(1)
                self.walk(node, page, pre, seen)
        elif tag == "li":  # outside any list
            self.indented(node, page, "- ", "  ", pre, seen)
        else:
            keeps = pre or tag in ("pre", "textarea", "listing", "plaintext")
            if keeps and not pre and node.children and isinstance(node.children[0], str):
                node.children[0] = node.children[0].removeprefix("\r").removeprefix("\n")
            self.walk(node, page, keeps, seen)
            if tag in ("td", "th"):  # outside any table
                page.text(" ")
        if block:
            page.end(gap)

    def indented(self, node: Node, page: Page, first: str, rest: str, pre: bool, seen: bool) -> None:
        inner = Page()
        self.walk(node, inner, pre, seen)
        for i, line in enumerate(inner.finished()):
            page.put(((first if i == 0 else rest) + line) if line else "")

    def items(self, node: Node, page: Page, pre: bool, seen: bool) -> None:
        ordered = node.tag == "ol"
        number, step = _whole(node.attrs.get("start"), 1), 1
        if ordered and "reversed" in node.attrs:
            step = -1
            if "start" not in node.attrs:
                number = sum(isinstance(c, Node) and c.tag == "li" for c in node.children)
        for child in node.children:
            if isinstance(child, str):
                if seen:
                    page.preformatted(child) if pre else page.text(child)
            elif not self.hidden(child):
                if child.tag == "li":
                    page.end(1)
                    number = _whole(child.attrs.get("value"), number)
                    mark = f"{number}. " if ordered else "- "
                    self.indented(child, page, mark, " " * len(mark), pre, seen)
                    page.end(1)
                    number += step
                elif child.tag in ("ul", "ol", "menu", "dir"):
                    inner = Page()
                    self.element(child, inner, pre, seen)
                    page.end(1)
                    for line in inner.finished():
                        page.put("  " + line if line else "")
                else:
                    self.element(child, page, pre, seen)

    def table(self, node: Node, page: Page, seen: bool) -> None:
        rows: list[Node] = []
        for part in node.children:
            if isinstance(part, str) or self.hidden(part):
                continue
            if part.tag == "tr":
                rows.append(part)
            elif part.tag in ("tbody", "thead", "tfoot"):
                rows += [r for r in part.children if isinstance(r, Node) and r.tag == "tr" and not self.hidden(r)]
            elif part.tag not in ("colgroup", "col"):
                self.element(part, page, False, seen)
        taken: dict[int, int] = {}  # column -> rows that a cell above still spans
        grid: list[list[tuple[int, int, list[str]]]] = []
        for row in rows:
            line, column = [], 0
            for cell in row.children:
                if isinstance(cell, str) or cell.tag not in ("td", "th") or self.hidden(cell):
                    continue
                while taken.get(column, 0):
                    column += 1
                inner = Page()
                style = cell.attrs.get("style", "")
                self.walk(cell, inner, False, bool(_SEEN.search(style)) or (seen and not _UNSEEN.search(style)))
                wide = min(SPAN, max(1, _whole(cell.attrs.get("colspan"), 1)))
                high = max(1, _whole(cell.attrs.get("rowspan"), 1))
                line.append((column, wide, inner.finished()))
                if high > 1:
                    for c in range(column, column + wide):
                        taken[c] = high
                column += wide
            grid.append(line)
            taken = {c: n - 1 for c, n in taken.items() if n > 1}
        widths: dict[int, int] = {}
        for line in grid:
            for column, wide, lines in line:
                if wide == 1:
                    fit = [len(x) for x in lines if len(x) <= WIDEST]
                    widths[column] = max(widths.get(column, 0), *fit, 0)
        used = sorted({column for line in grid for column, _, lines in line if lines} | {c for c, w in widths.items() if w})
        place, at = {}, 0
        for c in used:
            place[c] = at
            at += widths.get(c, 0) + 2
        page.end(2)
        for line in grid:
            for k in range(max((len(lines) for _, _, lines in line), default=0)):
                out = ""
                for column, _, lines in line:
                    if k < len(lines) and lines[k]:
                        out = out.ljust(place[column]) if len(out) <= place[column] - 2 or not out else out + "  "
                        out += lines[k]
                page.put(out)


def _whole(text: str | None, otherwise: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", text or "", re.A)
    return int(m[1]) if m else otherwise


def visible_text(html: str | None) -> str:
    """Visible text of a page; null and empty pages give an empty text."""
    if not html:
        return ""
    tree = Builder(html)
    renderer = Renderer(tree.styles)
    page = Page()
    if not renderer.hidden(tree.root):
        renderer.walk(tree.root, page, False, True)
    return "\n".join(page.finished())


def extract(pages: DataFrame, html: str = "html", column: str = "text") -> DataFrame:
    """Replace ``html`` by the visible text in ``column``; every row is kept, other columns pass through."""
    ship_package(pages.sparkSession)

    @F.pandas_udf(StringType())
    def text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([visible_text(h) for h in part], dtype=object)

    kept = [c for c in pages.columns if c not in (html, column)]
    return pages.select(*kept, text(html).alias(column))
