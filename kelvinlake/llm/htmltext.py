"""Visible text of HTML pages, laid out as a text browser would.

A tokenizer and a tree builder with the usual implied tags give a well-formed
sequence of opened and closed elements; a renderer walks it. Elements that are
never shown (head, script, style, ...), the ``hidden`` attribute and inline styles
display:none and visibility:hidden are left out. Blocks stand on lines of their
own, paragraphs, headings, lists, tables and quotations are set off by a blank
line, list items carry bullets or numbers and an indent by depth, ``pre`` keeps
its spacing, and table cells are padded to their column's width. Nothing that is
visible is left out, whatever its role on the page.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: element names of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
NEVER = frozenset(
    "head script style title template noscript noembed noframes iframe object audio video canvas datalist "
    "meta link base param source track area".split()
)
#: Never shown within svg or math; self-closing tags close there.
UNSHOWN = frozenset("desc defs metadata symbol annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "caption ul xmp tr tbody thead tfoot".split()
)
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul xmp menu dir".split())
ENDS_P = BLOCK - frozenset("body html caption option optgroup legend tr tbody thead tfoot".split())
SCOPE = frozenset("table td th caption html button object template".split())
#: End tags of these reach out of a table's cell; others don't.
OUTER = frozenset("html body table caption tr td th tbody thead tfoot".split())
CELLS = frozenset("td th table".split())
#: An opened element ends the first of these that is open above the nearest barrier.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split()) | SCOPE),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"]) | SCOPE),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"]) | SCOPE),
    "option": (frozenset(["option"]), frozenset(["select"]) | SCOPE),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "caption"]), frozenset(["table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "caption"]), frozenset(["table"])),
    "thead": (frozenset(["tbody", "thead", "tfoot", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot", "caption"]), frozenset(["table"])),
}

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?:!|\?)[^>]*(?:>|\Z)|</\s*([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    # a quote opens a value right after = only; elsewhere it is a character like others
    r"|<([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*)?+)*+)(?:>|\Z)",
    re.S,
)
_START = re.compile(r"(?:^|\s)start\s*=\s*[\"']?(-?\d{1,9})", re.I)
_SPAN = re.compile(r"(?:^|\s)colspan\s*=\s*[\"']?(\d{1,3})", re.I)
_ATTRIBUTE_TEXT = re.compile(r"=\s*(?:\"[^\"]*\"?|'[^']*'?|[^\s>]*)")
_SPACE = re.compile(r"[ \t\r\n\f]+")
#: Padding of a table column, at most; a longer cell is whole, but pads no other.
WIDEST = 40


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("open", name, attributes), ("close", name, ""), ("text", text, "") of a
    well-formed tree: each opened element is closed, in order."""
    stack: list[str] = []
    counts: dict[str, int] = {}

    def close(upto: int) -> Iterator[tuple[str, str, str]]:
        while len(stack) > upto:
            name = stack.pop()
            counts[name] -= 1
            yield "close", name, ""

    def opened(name: str, attributes: str) -> tuple[str, str, str]:
        stack.append(name)
        counts[name] = counts.get(name, 0) + 1
        return "open", name, attributes

    def index_above(names: frozenset[str], barrier: frozenset[str]) -> int:
        if not any(counts.get(n) for n in names):
            return -1
        for i in range(len(stack) - 1, -1, -1):
            if stack[i] in names:
                return i
            if stack[i] in barrier:
                break
        return -1

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", page[at:], ""
            break
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        if m[1]:
            name = m[1].lower()
            if name == "br":
                yield opened("br", "")
                yield from close(len(stack) - 1)
            elif name == "p" and not counts.get("p"):
                yield opened("p", "")
                yield from close(len(stack) - 1)
            elif counts.get(name):
                i = index_above(frozenset([name]), frozenset() if name in OUTER else CELLS)
                if i >= 0:
                    yield from close(i)
        elif m[2]:
            name, attributes = m[2].lower(), m[3] or ""
            if name in ENDS_P and counts.get("p"):
                i = index_above(frozenset(["p"]), SCOPE)
                if i >= 0:
                    yield from close(i)
            if name in IMPLIED:
                i = index_above(*IMPLIED[name])
                if i >= 0:
                    yield from close(i)
                if name in ("td", "th") and counts.get("table") and index_above(frozenset(["tr"]), frozenset(["table"])) < 0:
                    yield opened("tr", "")
            elif name == "body" and counts.get("head"):
                yield from close(index_above(frozenset(["head"]), frozenset()))
            elif counts.get("head") and name not in NEVER and name not in ("html", "head"):
                yield from close(index_above(frozenset(["head"]), frozenset()))
            elif name[0] == "h" and len(name) == 2 and stack and stack[-1] in ("h1", "h2", "h3", "h4", "h5", "h6") and name[1].isdigit():
                yield from close(len(stack) - 1)
            yield opened(name, attributes)
            if name in VOID or (attributes.endswith("/") and (counts.get("svg") or counts.get("math"))):
                yield from close(len(stack) - 1)
            elif name in RAW:
                stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                to = stop.start() if stop else end
                if to > at:
                    yield "text", page[at:to], ""
                at = to
                if stop is None:
                    yield from close(len(stack) - 1)
    yield from close(0)


def _chosen(found: Iterator[tuple[str, str, str]]) -> Iterator[tuple[str, str, str]]:
    """Events with each closed list of options cut to the one that it shows: the last
    selected, else the first that isn't disabled. Open lists keep all."""
    for event in found:
        if event[:2] != ("open", "select"):
            yield event
            continue
        bare = _ATTRIBUTE_TEXT.sub('=""', event[2])
        size = re.search(r"(?:^|\s)size\s*=\s*[\"']?(\d+)", event[2], re.I)
        yield event
        depth, options = 1, []
        every = re.search(r"(?:^|\s)multiple(?:\s|=|/|$)", bare, re.I) or (size and int(size[1]) > 1)
        for inner in found:
            depth += (inner[0] == "open") - (inner[0] == "close")
            if not depth or every:
                if not depth:
                    break
                yield inner
            elif inner[:2] == ("open", "option"):
                options.append((_ATTRIBUTE_TEXT.sub('=""', inner[2]), []))
            elif options and inner[:2] != ("close", "option"):
                options[-1][1].append(inner)
        has = lambda option, name: re.search(rf"(?:^|\s){name}(?:\s|=|/|$)", option[0], re.I)
        shown = [o for o in options if has(o, "selected")][-1:] or [o for o in options if not has(o, "disabled")][:1] or options[:1]
        for option in shown:
            yield from (e for e in option[1] if e[0] == "text")
        yield "close", "select", ""


class _Page:
    """Lines of one flow of blocks: a page, or one table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0  # blank lines wanted before the next text
        self.space = False
        self.mark = ""
        self.indent = 0

    def text(self, text: str) -> None:
        if not text:
            return
        parts = _SPACE.split(text)
        for i, word in enumerate(parts):
            if i:
                self.space = True
            if word:
                if self.now:
                    if self.space:
                        self.now.append(" ")
                self.now.append(word)
                self.space = False

    def raw(self, text: str) -> None:
        for i, line in enumerate(text.split("\n")):
            if i:
                self.end(hard=True)
            if line:
                self.now.append(line)

    def end(self, gap: int = 0, hard: bool = False) -> None:
        """Ends the line; ``hard`` keeps an empty one."""
        if self.now or hard:
            line = "".join(self.now)
            if self.lines and self.gap:
                self.lines.append("")
            self.gap = 0
            lead = "  " * max(0, self.indent - 1) if self.indent else ""
            if self.mark:
                line = f"{lead}{self.mark}{line}"
            elif self.indent and line:
                line = f"{'  ' * self.indent}{line}"
            self.mark = ""
            self.lines.append(line)
            self.now = []
        self.space = False
        if gap and self.lines:
            self.gap = 1


class _Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[str, int]]] = []

    def lines(self) -> list[str]:
        rows = [r for r in self.rows if any(c for c, _ in r)]
        width: dict[int, int] = {}
        for r in rows:
            at = 0
            for cell, span in r:
                if span == 1:
                    width[at] = max(width.get(at, 0), min(len(cell), WIDEST))
                at += span
        out = []
        for r in rows:
            at, parts = 0, []
            for k, (cell, span) in enumerate(r):
                room = sum(width.get(at + i, 0) for i in range(span)) + 3 * (span - 1)
                parts.append(cell if k == len(r) - 1 else cell.ljust(min(room, WIDEST * span)))
                at += span
            out.append(" | ".join(parts).rstrip())
        return out


def render(page: str | None) -> str:
    """The visible text of a page; empty for null, empty or wholly hidden pages."""
    if not page:
        return ""
    flow = _Page()
    flows: list[_Page] = []
    tables: list[_Table] = []
    lists: list[int | None] = []
    hidden = pre = depth = 0
    hidden_at: list[int] = []
    drawn = 0  # open svg and math elements
    for kind, x, attributes in _chosen(events(page)):
        if kind == "text":
            if hidden or (not flow.now and not pre and x.isspace()):
                flow.space = flow.space or bool(flow.now)
                continue
            x = _html.unescape(x) if "&" in x else x
            flow.raw(x.replace("\r\n", "\n")) if pre else flow.text(x.replace("\xa0", " ") if "\xa0" in x else x)
        elif kind == "open":
            depth += 1
            drawn += x in ("svg", "math")
            if hidden or x in NEVER or (drawn and x in UNSHOWN) or (attributes and ("hidden" in attributes.lower() or "none" in attributes.lower()) and _is_hidden(attributes)):
                if not hidden:
                    hidden_at.append(depth)
                    hidden = 1
                continue
            if x == "br":
                flow.end(hard=True)
            elif x in BLOCK:
                flow.end(gap=x in SPACED and not (x in ("ul", "ol") and lists))
                if x in ("ul", "ol", "menu", "dir"):
                    start = _START.search(attributes)
                    lists.append((int(start[1]) if start else 1) if x == "ol" else None)
                    flow.indent += 1
                elif x == "li":
                    if lists and lists[-1] is not None:
                        flow.mark = f"{lists[-1]}. "
                        lists[-1] += 1
                    else:
                        flow.mark = "- "
                    flow.indent = max(flow.indent, 1) if lists else 1
                elif x in ("dd", "blockquote"):
                    flow.indent += 1
                elif x in ("pre", "xmp"):
                    pre += 1
                elif x == "table":
                    tables.append(_Table())
                elif x == "tr" and tables:
                    tables[-1].rows.append([])
            elif x in ("td", "th") and tables:
                flows.append(flow)
                flow = _Page()
                span = _SPAN.search(attributes) if attributes else None
                flow.span = max(1, int(span[1])) if span else 1
                flow.kept = (lists, pre)
                lists, pre = [], 0
        else:
            drawn -= x in ("svg", "math")
            if hidden:
                if hidden_at[-1] == depth:
                    hidden_at.pop()
                    hidden = 0
                depth -= 1
                continue
            depth -= 1
            if x in BLOCK:
                flow.end(gap=x in SPACED and not (x in ("ul", "ol") and len(lists) > 1))
                if x in ("ul", "ol", "menu", "dir"):
                    if lists:
                        lists.pop()
                    flow.indent = max(0, flow.indent - 1)
                    flow.mark = ""
                elif x == "li":
                    flow.mark = ""
                    if not lists:
                        flow.indent = 0
                elif x in ("dd", "blockquote"):
                    flow.indent = max(0, flow.indent - 1)
                elif x in ("pre", "xmp"):
                    pre -= 1
                elif x == "table" and tables:
                    for line in tables.pop().lines():
                        flow.now = [line]
                        flow.end()
                    flow.end(gap=1)
            elif x in ("td", "th") and flows:
                flow.end()
                cell = " ".join(line.strip() for line in flow.lines if line.strip())
                lists, pre = flow.kept
                span, flow = flow.span, flows.pop()
                if tables:
                    if not tables[-1].rows:
                        tables[-1].rows.append([])
                    tables[-1].rows[-1].append((cell, span))
    flow.end()
    return "\n".join(flow.lines).strip("\n")


def _is_hidden(attributes: str) -> bool:
    # the bare attribute must not be looked for within quoted values
    bare = _ATTRIBUTE_TEXT.sub('=""', attributes)
    if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", bare, re.I):
        return True
    style = re.search(r"(?:^|\s)style\s*=\s*(\"[^\"]*\"|'[^']*'|\S+)", attributes, re.I)
    return bool(style and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", style[1], re.I))


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, text`` of every row of ``pages(page_id, html)``.

    A null or empty page gives an empty text; repeated rows give repeated results;
    other columns are not read. Empty in, empty out.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [render(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(texts, pa.string())], ["page_id", "text"])

    return pages.select("page_id", F.col("html")).mapInArrow(run, "page_id long, text string")
