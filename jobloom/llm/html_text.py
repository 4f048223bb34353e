"""Layout-aware text of HTML pages.

A tree builder reads tags with the implied ones (``li``, ``p``, ``td`` and the like end by themselves, a cell
makes its row and a row its table), drops what a browser does not show, and renders elements as they
close: blocks stand on their own lines, paragraphs and headings apart from each other, list items carry
their marker and indentation, and table cells are padded to aligned columns, which spans of columns and rows
keep. ``pre`` keeps its white space. Hidden is what its tag, its ``hidden`` or ``style`` attribute or a rule of
the page's ``<style>`` elements hides, a dialog that is not open, and what a closed ``details`` holds beside its
summary; rules count if they select by one tag, by classes or by an id.

Time and text grow in proportion to the page. Every line is laid out once, in one pass over the finished parts. As in
browsers the tree has at most ``DEEPEST`` levels: further elements stand beside each other. Items more than ``INDENTED``
levels deep show their level as a number instead of blanks, tables within ``NESTED`` others show a cell a line, and
where padding would take more than the page has bytes, cells after a very wide one begin a line, or none are padded.
No text is dropped.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes noscript".split())
HIDDEN = frozenset("head script style title template noscript iframe noembed noframes object datalist audio video canvas svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table ul tr td th thead tbody tfoot caption".split()
)
APART = frozenset("p h1 h2 h3 h4 h5 h6 blockquote dl figure table pre ul ol menu hr".split())  # a blank line around
#: Start tags that end an open element, and the elements that stop the search for it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "tr": ({"tr", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "button": ({"button"}, {"td", "th", "table", "caption", "object", "template"}),
}
SCOPE = frozenset({"td", "th", "table", "caption", "html"})  # end tags do not reach out of these
OWN = frozenset({"td", "th", "tr", "table"})  # rendered on their own
INDENTS = frozenset({"li", "blockquote"})  # their lines are indented
SPECIAL = BLOCK | {"object", "template", "button", "select"}  # end tags of other inline elements do not reach out of these
#: Misnested, they begin anew after the end of what held them.
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
FOREIGN = frozenset({"svg", "math"})
#: Within foreign content, what holds HTML again, and the tags that end it.
INTEGRATION = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
BREAKOUT = HEADINGS | frozenset(
    "b big blockquote body br center code dd div dl dt em embed head hr i img li listing menu meta nobr ol p pre "
    "ruby s small span strong strike sub sup table tt u ul var".split()
)

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: An attribute before its value: name, and whether a value follows.
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*(=)\s*)?")
_VALUE = re.compile(r"[^\s>]*")
_COMMENT_END = re.compile("--!?>")
_GAP = re.compile(r"[\s/]*")
_RAW_OR_COMMENT = re.compile(rf"<!--|<({'|'.join(sorted(RAW))})(?=[\s/>])", re.I)
_SPACE = re.compile(r"[ \t\n\f\r]+")
_DISPLAY = re.compile(r"(?<![\w-])display\s*:\s*([\w-]+)(\s*!\s*important)?", re.I)
_VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(hidden|collapse|visible)(\s*!\s*important)?", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)$")
#: Rows and columns that a cell may span (fixed by the HTML standard).
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: Levels of the tree, of indentation by blanks, and of tables within cells; a very wide cell.
DEEPEST, INDENTED, NESTED, VERY_WIDE = 512, 12, 6, 100


class Tag(NamedTuple):
    """A start tag (``closes``: an end tag) that ends before ``end``."""

    name: str
    closes: bool
    attributes: dict[str, str]
    alone: bool  #: whether it ends in a slash
    end: int


def read_tag(html: str, at: int) -> Tag | None:
    """The tag whose name begins at ``at``; None if the page ends within it. Every character is read once."""
    closes = html[at] == "/"
    name = _NAME.match(html, at + closes)
    if html[name.end() : name.end() + 1] == ">":
        return Tag(name[0].lower(), closes, {}, False, name.end() + 1)
    at, attributes, n = name.end(), {}, len(html)
    while True:
        m = _ATTRIBUTE.match(html, at)
        if m is None:
            gap = _GAP.match(html, at).end()
            return None if gap >= n else Tag(name[0].lower(), closes, attributes, gap > at and html[gap - 1] == "/", gap + 1)
        at, value = m.end(), ""
        if m[2]:
            quote = html[at : at + 1]
            if quote and quote in "\"'":
                close = html.find(quote, at + 1)
                if close < 0:
                    return None
                value, at = html[at + 1 : close], close + 1
            else:
                unquoted = _VALUE.match(html, at)
                value, at = unquoted[0], unquoted.end()
        attributes.setdefault(m[1].lower(), unescape(value) if "&" in value else value)


def scan(html: str) -> Iterator[str | Tag]:
    """Text and tags of a page. After a start tag of ``RAW`` the caller may send where the scan goes on."""
    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            yield html[at:]
            return
        if lt > at:
            yield html[at:lt]
        follows = html[lt + 1 : lt + 2]
        if follows.isascii() and (follows.isalpha() or (follows == "/" and html[lt + 2 : lt + 3].isascii() and html[lt + 2 : lt + 3].isalpha())):
            tag = read_tag(html, lt + 1)
            if tag is None:
                return
            moved = yield tag
            at = tag.end if moved is None else moved
        elif follows in ("!", "?", "/"):
            if html.startswith("<!--", lt):
                if html.startswith((">", "->"), lt + 4):
                    at = html.index(">", lt + 4) + 1
                    continue
                end = _COMMENT_END.search(html, lt + 4)
                at = n if end is None else end.end()
            else:
                end = html.find(">", lt + 1)
                at = n if end < 0 else end + 1
        else:
            yield "<"
            at = lt + 1


def raw_end(html: str, at: int, tag: str) -> tuple[int, int]:
    """Where the content of a raw element ends, and where its end tag does."""
    close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
    if close is None:
        return len(html), len(html)
    found = read_tag(html, close.start() + 1)
    return close.start(), len(html) if found is None else found.end


def style_sheets(html: str) -> str:
    """The content of the style elements, outside comments and other raw text; nothing else is read."""
    css: list[str] = []
    at = 0
    while (m := _RAW_OR_COMMENT.search(html, at)) is not None:
        if m[1] is None:
            end = _COMMENT_END.search(html, m.end())
            at = len(html) if end is None else end.end()
            continue
        tag = read_tag(html, m.start() + 1)
        if tag is None:
            break
        end, at = raw_end(html, tag.end, tag.name)
        if tag.name == "style":
            css.append(html[tag.end : end])
    return "\n".join(css)


class Asked(NamedTuple):
    """Something asked for or not (None), and whether it is important."""

    value: bool | None = None
    strong: bool = False

    def over(self, other: Asked) -> Asked:
        """This one where it asks for something and is not the weaker."""
        return other if self.value is None or (other.strong and not self.strong) else self


class Rule(NamedTuple):
    """A style rule that takes elements out or makes them invisible."""

    weight: tuple[int, int, int]
    tag: str | None
    classes: frozenset[str]
    id: str | None
    gone: Asked
    dim: Asked


def asked(declarations: str) -> tuple[Asked, Asked]:
    """Whether declarations take an element out, and whether they make it invisible."""
    gone = dim = Asked()
    for value, strong in _DISPLAY.findall(declarations):
        gone = Asked(value.lower() == "none", bool(strong)).over(gone)
    for value, strong in _VISIBILITY.findall(declarations):
        dim = Asked(value.lower() != "visible", bool(strong)).over(dim)
    return gone, dim


def style_rules(css: str) -> list[Rule]:
    """Rules of a style sheet that show or hide, weakest first; blocks of ``@media`` count for screens and all."""
    rules: list[Rule] = []
    if "display" not in css.lower() and "visibility" not in css.lower():
        return rules
    css = _COMMENT.sub(" ", css)
    at, inside = 0, [True]
    while (opened := css.find("{", at)) >= 0:
        ended = css.find("}", at)
        if 0 <= ended < opened:
            at = ended + 1
            if len(inside) > 1:
                inside.pop()
            continue
        head = css[at:opened].rpartition(";")[2].strip()
        if head.startswith("@"):
            media = head.lower()
            inside.append(inside[-1] and media.startswith("@media") and ("screen" in media or "all" in media) and "not" not in media)
            at = opened + 1
            continue
        close = css.find("}", opened)
        body, at = css[opened + 1 : close if close >= 0 else len(css)], close + 1 if close >= 0 else len(css)
        gone, dim = asked(body)
        if not inside[-1] or (gone.value is None and dim.value is None):
            continue
        for selector in head.split(","):
            m = _SELECTOR.match(selector.strip())
            if m is None or not m[0]:
                continue
            classes = frozenset(re.findall(r"\.([\w-]+)", m[2]))
            ids = re.findall(r"#([\w-]+)", m[2])
            tag = m[1].lower() if m[1] and m[1] != "*" else None
            rules.append(Rule((len(ids), len(classes), tag is not None), tag, classes, ids[0] if ids else None, gone, dim))
    merged: dict[tuple, Rule] = {}  # of rules with the same selector the later ones win
    for rule in rules:
        key = (rule.tag, rule.classes, rule.id, rule.weight)
        before = merged.pop(key, rule)
        merged[key] = rule._replace(gone=rule.gone.over(before.gone), dim=rule.dim.over(before.dim))
    return sorted(merged.values(), key=lambda rule: rule.weight)


class Cell(NamedTuple):
    text: str
    span: int  #: columns
    down: int  #: rows; 0 for the rest of its group


class Element:
    __slots__ = ("tag", "out", "hides", "dims", "gone", "dim", "pre", "rows", "cells", "count", "span", "down", "foreign", "closed", "plain")

    def __init__(self, tag: str, out: list, hides: bool, dims: bool | None, pre: bool):
        self.tag, self.out, self.pre = tag, out, pre
        self.hides, self.dims = hides, dims  # what the element asks for itself
        self.gone, self.dim = hides, bool(dims)
        self.rows: list[list[Cell] | None] | None = None  # None: a group of rows ends
        self.cells: list[Cell] | None = None
        self.count, self.span, self.down = 0, 1, 1
        self.foreign = False  # part of an image or a formula
        self.closed = False  # details that show their first summary only
        self.plain = False  # of a table within too many others


class Indent(NamedTuple):
    """The lines from here on are indented; the first one carries the marker."""

    marker: str
    width: int


#: The lines up to here were indented.
DEDENT = object()


def flow(parts: list) -> str:
    """Lines of inline text (str), finished blocks (tuple of one str), breaks (int: line ends wanted), indents and dedents.

    Breaks at the beginning and the end of what is indented do not count.
    """
    done: list[str] = []
    line: list[str] = []
    wanted = 0
    frames: list[Indent] = []
    due: list[int] = []  # frames whose marker no line has carried yet
    first = 0  # frames that have no line yet

    def end_line() -> None:
        text = "".join(line).strip(" ")
        line.clear()
        if text:
            put(_SPACE.sub(" ", text) if "\0" not in text else text.replace("\0", ""))

    def put(text: str) -> None:
        nonlocal wanted, first
        if done:
            done.append("\n" * max(1, wanted))
        if frames:
            shown = frames if len(frames) <= INDENTED else [*frames[: INDENTED - 1], frames[-1]]
            numbers = [*range(len(frames))] if shown is frames else [*range(INDENTED - 1), len(frames) - 1]
            waiting = set(due[: INDENTED - 1]) | set(due[-1:])
            prefix = [frame.marker if n in waiting else " " * frame.width for n, frame in zip(numbers, shown, strict=True)]
            if shown is not frames:
                prefix.insert(-1, f"[{len(frames)}] ")
            due.clear()
            done.append("".join(prefix))
        done.append(text)
        wanted = first = 0

    for part in parts:
        if isinstance(part, str):
            line.append(part)
        elif isinstance(part, int):
            end_line()
            if not first:
                wanted = max(wanted, part) if part != 3 else max(wanted + 1, 1)
        elif isinstance(part, Indent):
            end_line()
            if part.marker:
                due.append(len(frames))
            frames.append(part)
            first += 1
        elif part is DEDENT:
            end_line()
            frames.pop()
            if due and due[-1] == len(frames):
                due.pop()
            if first:
                first -= 1
            else:
                wanted = 0
        else:
            end_line()
            for text in part[0].split("\n"):
                if text:
                    put(text)
    end_line()
    return "".join(done)


def width(text: str) -> int:
    """Columns that a line takes: wide East Asian characters two, combining marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Budget:
    """What a page may still spend on padding and on cells that span rows."""

    def __init__(self, size: int) -> None:
        self.blanks = self.spans = 4 * size + (1 << 16)


def grid(rows: list[list[Cell] | None], budget: Budget) -> str:
    """Rows of cells padded to aligned columns, two blanks apart; a cell stands in the first of its rows.

    If that takes more blanks than are left, very wide cells do not widen their column and end their line, and if
    it still does, nothing is padded.
    """
    placed = _place(rows, budget)
    cells = [[(at, cell.span, [(text, width(text)) for text in cell.text.split("\n")]) for at, cell in row] for row in placed]
    for widest in (None, VERY_WIDE, 0):
        lines = list(_lines(cells, widest))
        blanks = sum(begin for line in lines for begin, _ in line)
        if widest == 0 or blanks <= budget.blanks:
            budget.blanks -= blanks if widest != 0 else 0
            return "\n".join("".join(" " * begin + text for begin, text in line).rstrip() for line in lines)
    return ""


def _place(rows: list[list[Cell] | None], budget: Budget) -> list[list[tuple[int, Cell]]]:
    """The column of each cell. Beyond the budget cells no longer make room for those that span rows."""
    placed: list[list[tuple[int, Cell]]] = []
    taken: dict[int, float] = {}  # column -> rows for which a cell from above holds it
    for row in rows:
        if row is None or budget.spans <= 0:
            taken = {}
        if row is None:
            continue
        budget.spans -= len(taken)
        here, at, held = [], 0, {column: left - 1 for column, left in taken.items() if left > 1}
        for cell in row:
            while at in taken:
                at += 1
            here.append((at, cell))
            if cell.down != 1 and budget.spans > 0:
                held |= dict.fromkeys(range(at, at + cell.span), cell.down - 1 if cell.down else float("inf"))
                budget.spans -= cell.span
            at += cell.span
        taken = held
        placed.append(here)
    return placed


def _lines(cells: list[list[tuple[int, int, list[tuple[str, int]]]]], widest: int | None) -> Iterator[list[tuple[int, str]]]:
    """Each line as (blanks, text) pieces."""
    wide: Counter[int] = Counter()
    for row in cells:
        for at, span, text in row:
            if span == 1 and widest != 0:
                wide[at] = max(wide[at], *(n for _, n in text if widest is None or n <= widest), 0)
    columns = sorted(wide)
    sums = [0, *accumulate(wide[column] for column in columns)]
    last = columns[-1] + 1 if columns else 0
    for row in cells:
        k = 0
        while row:
            line, reached = [], 0
            for at, _, text in row:
                shown, size = text[k]
                if not shown:
                    continue
                begin = 2 * min(at, last) + sums[bisect_left(columns, at)]  # columns are two blanks apart
                begin = max(begin, reached + 2 if reached else 0)
                line.append((begin - reached, shown))
                reached = begin + size
                if widest and size > widest:
                    yield line
                    line, reached = [], 0
            if line:
                yield line
            k += 1
            row = [cell for cell in row if len(cell[2]) > k]


class Page:
    """The open elements of a page; ``text()`` is what it shows."""

    def __init__(self, rules: list[Rule] | None = None, size: int = 0) -> None:
        self.root = Element("#root", [], False, None, False)
        self.open = [self.root]
        self.tags: Counter[str] = Counter()
        #: Where in ``open`` each tag stands; ``#special`` and ``#scope`` for all of those.
        self.places: dict[str, list[int]] = {"#special": [], "#scope": []}
        self.title: str | None = None
        self.budget = Budget(size)
        self.begun = False  # a pre has just begun
        self.by_tag: dict[str, list[int]] = {}
        self.by_class: dict[str, list[int]] = {}
        self.by_id: dict[str, list[int]] = {}
        self.known: dict[tuple, tuple[Asked, Asked]] = {}
        self.rules = rules or []
        named = Counter(name for rule in self.rules for name in rule.classes)
        for k, rule in enumerate(self.rules):
            if rule.id is not None:
                self.by_id.setdefault(rule.id, []).append(k)
            elif rule.classes:
                self.by_class.setdefault(min(rule.classes, key=named.__getitem__), []).append(k)
            else:
                self.by_tag.setdefault(rule.tag or "*", []).append(k)

    def feed(self, html: str) -> None:
        tokens = scan(html)
        token = next(tokens, None)
        while token is not None:
            moved = None
            if isinstance(token, str):
                self.characters(token)
            elif token.closes:
                self.end(token.name)
            elif self.start(token.name, token.attributes, token.alone) and token.name in RAW:
                end, moved = raw_end(html, token.end, token.name)
                content = html[token.end : end]
                if token.name == "title" and self.title is None:
                    self.title = _SPACE.sub(" ", unescape(content)).strip()
                self.characters(content, raw=token.name != "textarea")
                self.end(token.name)
            try:
                token = tokens.send(moved)
            except StopIteration:
                return

    def styled(self, tag: str, attributes: dict[str, str]) -> tuple[Asked, Asked]:
        """What the style sheets and the element's own style ask for."""
        gone = dim = Asked()
        if self.rules:
            key = (tag, attributes.get("id", ""), attributes.get("class", ""))
            if key not in self.known:
                classes = set(key[2].split())
                found = [*self.by_tag.get(tag, ()), *self.by_tag.get("*", ()), *self.by_id.get(key[1], ())]
                found += [k for name in classes for k in self.by_class.get(name, ())]
                for k in sorted(found):
                    rule = self.rules[k]
                    if rule.classes <= classes and rule.tag in (None, tag):
                        gone, dim = rule.gone.over(gone), rule.dim.over(dim)
                self.known[key] = gone, dim
            gone, dim = self.known[key]
        if style := attributes.get("style"):
            own = asked(style)
            gone, dim = own[0].over(gone), own[1].over(dim)
        return gone, dim

    def characters(self, text: str, raw: bool = False) -> None:
        begun, self.begun = self.begun, False
        top = self.open[-1]
        if top.tag == "head" and not raw and text.strip():
            self.pop()
            top = self.open[-1]
        if top.gone or top.dim or raw or top.closed:
            return
        if "&" in text:
            text = unescape(text)
        if top.pre:
            text = text.replace("\r\n", "\n")
            lines = (text[1:] if begun and text.startswith("\n") else text).split("\n")
            for k, line in enumerate(lines):
                if k:
                    top.out.append(3)
                if line:
                    top.out.append("\0" + line.replace("\t", "        "))
        elif top.tag in ("table", "tr", "ul", "ol") and not text.strip():
            return
        else:
            top.out.append(_SPACE.sub(" ", text))

    def push(self, e: Element) -> None:
        at = len(self.open)
        self.open.append(e)
        self.tags[e.tag] += 1
        self.places.setdefault(e.tag, []).append(at)
        if e.tag in SPECIAL:
            self.places["#special"].append(at)
        if e.tag in SCOPE:
            self.places["#scope"].append(at)

    def unpush(self) -> Element:
        e = self.open.pop()
        self.tags[e.tag] -= 1
        self.places[e.tag].pop()
        if e.tag in SPECIAL:
            self.places["#special"].pop()
        if e.tag in SCOPE:
            self.places["#scope"].pop()
        return e

    def last(self, *tags: str) -> int:
        """Where the innermost open element of the tags stands; 0 if none does."""
        return max((at[-1] for tag in tags if (at := self.places.get(tag))), default=0)

    def start(self, tag: str, attributes: dict[str, str] | None = None, alone: bool = False) -> bool:
        """Open an element; False if the tag leaves none open or its content is no raw text."""
        self.begun = False
        attributes = attributes or {}
        if tag == "head" and self.open[-1].tag not in ("#root", "html"):
            return False
        if tag not in IN_HEAD and self.tags["head"]:
            self.close_upto({"head"}, {"template"})
        while self.open[-1].foreign and tag in BREAKOUT:
            self.close_upto(FOREIGN, frozenset())
        within = self.open[-1].foreign
        if (within or tag in FOREIGN) and alone:
            return False
        if tag == "a" and self.tags["a"]:
            self.end("a")
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.pop()
        if tag in ENDS and self.tags:
            self.close_upto(*ENDS[tag])
        if tag in BLOCK and self.tags["p"] and tag not in ("html", "body", "option", "optgroup"):
            self.close_upto({"p"}, SCOPE)
        if tag in ("td", "th") and self.open[-1].tag != "tr":
            self.start("tr")
        if tag == "tr" and not self.tags["table"]:
            self.start("table")
        while len(self.open) >= DEEPEST:
            self.pop()
        top = self.open[-1]
        hides, dims, span, down = tag in HIDDEN or (tag == "dialog" and "open" not in attributes), None, 1, 1
        if top.closed and tag not in VOID:
            hides |= tag != "summary" or top.count > 0
            top.count += tag == "summary"
        if attributes or self.rules:
            unseen, dimmed = self.styled(tag, attributes)
            dims = dimmed.value
            hides |= unseen.value if unseen.value is not None else "hidden" in attributes
            if tag in ("td", "th"):
                span = _spanned(attributes.get("colspan"), MOST_COLUMNS) or 1
                down = _spanned(attributes.get("rowspan"), MOST_ROWS)
        gone = top.gone or hides
        if tag in VOID:
            if not gone and tag == "br":
                top.out.append(3)
            elif not gone and tag == "hr":
                top.out.append(2)
            return False
        plain = tag in OWN and self.tags["table"] + (tag == "table") > NESTED
        new = Element(tag, [] if tag in OWN and not plain and not gone else top.out, hides, dims, (top.pre or tag in ("pre", "textarea")))
        new.gone, new.dim = gone, top.dim if dims is None else dims
        new.span, new.down, new.plain = span, down, plain
        new.foreign = tag in FOREIGN or (within and tag not in INTEGRATION)
        new.closed = tag == "details" and "open" not in attributes
        if not gone:
            self.opens(new, top, attributes)
        if tag == "ol":
            new.count = _whole(attributes.get("start"), 1) - 1
        if tag == "table":
            new.rows = []
        elif tag == "tr":
            new.cells = []
        self.push(new)
        self.begun = tag in ("pre", "textarea", "listing")
        return not within

    def opens(self, e: Element, up: Element, attributes: dict[str, str]) -> None:
        """What stands before the content of a visible element."""
        if e.tag == "li":
            up.count = _whole(attributes.get("value"), up.count + 1) if up.tag == "ol" else up.count + 1
            marker = f"{up.count}. " if up.tag == "ol" else "- "
            up.out += [1, Indent(marker, len(marker))]
        elif e.tag == "blockquote":
            up.out += [2, Indent("", 2)]
        elif e.plain or e.tag not in OWN:
            self.apart(e, up.out)

    def closes(self, e: Element, up: Element) -> None:
        """What stands after it."""
        if e.tag in INDENTS:
            e.out += [DEDENT, 1 if e.tag == "li" else 2]
        else:
            self.apart(e, up.out)

    def apart(self, e: Element, out: list) -> None:
        """The break around a block that is not rendered on its own."""
        if e.tag in BLOCK:
            out.append(2 if e.tag in APART and not e.plain and not (e.tag in ("ul", "ol", "menu") and self.tags["li"]) else 1)

    def close_upto(self, tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        """End the nearest open element of ``tags`` and all within it, unless ``stop`` comes first."""
        while (k := self.last(*tags)) > self.last(*(stop - tags)):
            tag = self.open[k].tag
            while len(self.open) > k:
                self.pop()
            if tag not in ("tr", "option") or len(tags) == 1:
                return
            tags = tags - {tag}

    def end(self, tag: str) -> None:
        self.begun = False
        if tag == "br":
            self.start("br")
            return
        if not self.tags[tag]:
            if tag == "p" and not self.open[-1].gone:
                self.open[-1].out.append(2)
            return
        if tag in BLOCK or tag in HIDDEN:
            self.close_upto({tag}, SCOPE - {tag} if tag not in ("table", "body", "html") else frozenset())
            return
        k = self.last(tag)
        blocks = self.last("#special") > k
        if self.last("#scope") < k and not (blocks and tag not in FORMATTING):
            self.take_out(k, blocks)

    def take_out(self, k: int, blocks: bool) -> None:
        """End the inline element at ``k``: blocks within it stay open, and so do misnested formatting elements."""
        held = [self.unpush() for _ in range(len(self.open) - k - 1)][::-1]
        self.unpush()
        for e in held:
            if not blocks and e.tag not in FORMATTING:
                continue
            up = self.open[-1]
            gone, e.gone, e.dim = e.gone, up.gone or e.hides, up.dim if e.dims is None else e.dims
            e.foreign = e.tag in FOREIGN or (up.foreign and e.tag not in INTEGRATION)
            if gone and not e.gone:
                e.out = [] if e.tag in OWN and not e.plain else up.out
                self.opens(e, up, {})
            self.push(e)

    def pop(self) -> None:
        done = self.unpush()
        up = self.open[-1]
        tag = done.tag
        if done.gone:
            return
        table = self.open[self.last("table")] if self.tags["table"] else None
        if tag in ("thead", "tbody", "tfoot") and table is not None and table.rows is not None:
            table.rows.append(None)
        if tag not in OWN or done.plain:
            self.closes(done, up)
        elif tag in ("td", "th"):
            (up.cells if up.cells is not None else []).append(Cell(flow(done.out), done.span, done.down))
        elif tag == "tr":
            if table is not None and table.rows is not None and done.cells:
                table.rows.append(done.cells)
            up.out += done.out
        else:
            up.out += [2, *done.out, 1]
            if any(done.rows):
                up.out += [(grid(done.rows, self.budget),)]
            up.out += [2]

    def text(self) -> str:
        while len(self.open) > 1:
            self.pop()
        return flow(self.root.out)


def _whole(value: str | None, otherwise: int) -> int:
    """A whole number of up to nine digits."""
    m = re.match(r"\s*(-?\d{1,9})(?!\d)", value or "", re.A)
    return int(m[1]) if m else otherwise


def _spanned(value: str | None, most: int) -> int:
    value = (value or "").strip()
    return min(most, int(value[:9])) if value.isascii() and value.isdigit() else 1


def read_page(html: str | None) -> tuple[str | None, str]:
    """The title and the visible text of a page; null and empty pages have none and show nothing."""
    if not html:
        return None, ""
    page = Page(style_rules(style_sheets(html)), len(html))
    page.feed(html)
    text = page.text()
    return page.title, text


def page_text(html: str | None) -> str:
    return read_page(html)[1]


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(at, 200) for whole in batches for at in range(0, len(whole), 200)):
        pages = [read_page(html) for html in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([title for title, _ in pages], pa.string()),
                pa.array([text for _, text in pages], pa.string()),
            ],
            names=["page_id", "url", "title", "text"],
        )


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, title, text`` of every row of ``pages(page_id, url, html, ...)``.

    Null or empty html gives empty text and a null title. Pages of any length and depth are read whole, in time
    and with text in proportion to their length (what is deeper or wider than a line can show is laid out plainer);
    repeated rows and null ids are rendered like any other; other columns are ignored.
    """
    columns = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return columns.mapInArrow(_render, "page_id long, url string, title string, text string")
