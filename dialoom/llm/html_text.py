"""HTML extraction by layout-aware rendering: all visible text, with block spacing, lists and aligned table cells.

A tokenizer cuts tags, comments and raw text; a tree builder keeps the stack of open elements and adds the tags that HTML
implies (an open p ends before a block, li before li, dt/dd, options, table parts; end tags close what they leave open and
are dropped where nothing matches). Elements are hidden by their tag (head, script, style, template, noscript, ...), the
hidden attribute, or display:none in their style or in a rule of the page's style sheets that names a tag, classes or an id
(other selectors, and rules for print, count for nothing). visibility:hidden hides text until a descendant turns it visible.
What stays is laid out as text:
  white space collapses, except in pre and textarea;
  blocks start lines, and paragraphs, headings, lists, tables and quotes stand apart by an empty line;
  list items get `* ` or their number and their lines are indented below it; quotes are indented by `> `; below DEEPEST
  levels indents grow no more and a line names its level as `[n] `, so that output stays in proportion to the page;
  table rows take a line for each line of their highest cell, columns are aligned (up to 80 characters wide, lest one long
  cell widens every row), and cells that span columns or rows keep others out of their places.

Defined results: null or empty html gives an empty text; broken markup is read as far as a browser would keep its text;
pages of any length and depth are rendered whole, without recursion; repeated rows each get a row; an empty table gives
an empty one; further columns are ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import on_texts, sliced

# Fixed values of HTML: elements by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE = frozenset("title textarea".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes object svg math audio video canvas datalist select".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table caption tbody td tfoot th thead tr ul".split()
)
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset menu dir".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
# An opening tag ends the open elements named first, unless one of those named second lies between.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir", "table"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th", "caption"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
}
SCOPE = frozenset("td th caption table html template".split())

TOKEN = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(?:!|\?|/(?![a-zA-Z]))[^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>)", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SHOWN = re.compile(r"(display|visibility)\s*:\s*([a-z-]+)", re.I)
STYLE = re.compile(r"<style\b([^>]*)>(.*?)(?:</style\b|\Z)", re.I | re.S)
SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)\Z")
SPACES = re.compile(r"[ \t\n\r\f]+")
WIDEST = 80
DEEPEST = 16
# Fixed values of HTML: the most columns and rows that a cell spans.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


def declared(style: str) -> dict[str, str]:
    """display and visibility of a list of declarations; the last of each counts."""
    return {m[1].lower(): m[2].lower() for m in SHOWN.finditer(style)}


class Rules:
    """What style sheets say about display and visibility, by tag, classes and id."""

    def __init__(self, page: str) -> None:
        self.of: dict[str, list[tuple[int, int, str, frozenset[str], dict[str, str]]]] = {}
        for m in STYLE.finditer(page):
            if "print" not in m[1].lower():
                self.read(re.sub(r"/\*.*?\*/", "", m[2], flags=re.S))

    def read(self, sheet: str) -> None:
        at, skipping, depth, order = 0, 0, 0, 0
        for m in re.finditer(r"[{}]", sheet):
            head = sheet[at : m.start()].strip()
            at = m.end()
            if m[0] == "{":
                depth += 1
                if not skipping and head.startswith("@") and ("print" in head.lower() or not head.lower().startswith(("@media", "@supports", "@layer"))):
                    skipping = depth
                self.head = head
                continue
            if not skipping and not self.head.startswith("@") and (says := declared(head)):
                for selector in self.head.split(","):
                    self.add(selector.strip(), says, order)
                    order += 1
            self.head = "@"
            if skipping == depth:
                skipping = 0
            depth = max(0, depth - 1)

    def add(self, selector: str, says: dict[str, str], order: int) -> None:
        m = SELECTOR.match(selector)
        if not m or not selector:
            return
        names = frozenset(re.findall(r"[.#][\w-]+", m[2]))
        tag = (m[1] or "*").lower()
        weight = 100 * sum(x[0] == "#" for x in names) + 10 * sum(x[0] == "." for x in names) + (tag != "*")
        self.of.setdefault(min(names) if names else tag, []).append((weight, order, tag, names, says))

    def says(self, tag: str, found: dict[str, str]) -> dict[str, str]:
        own = {f".{x}" for x in found.get("class", "").split()}
        if "id" in found:
            own.add(f"#{found['id'].strip()}")
        hits = [r for key in (*own, tag, "*") for r in self.of.get(key, ()) if r[2] in (tag, "*") and r[3] <= own]
        out: dict[str, str] = {}
        for *_, says in sorted(hits, key=lambda r: r[:2]):
            out |= says
        return out


class Flow:
    """Lines of text under construction."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.indents: list[str] = []
        self.mark: str | None = None
        self.space = self.started = False
        self.gap = 0

    def _start(self) -> None:
        if not self.started:
            if self.gap > 1 and self.lines:
                self.lines.append("")
            deep = len(self.indents) - (self.mark is not None)
            lead = "".join(self.indents[: min(deep, DEEPEST)])
            if deep > DEEPEST:
                lead += f"[{deep}] "
            if self.mark is not None:
                lead += self.mark
                self.mark = None
            self.now, self.started, self.gap = [lead], True, 0

    def end_line(self) -> None:
        if self.started:
            self.lines.append("".join(self.now).rstrip(" "))
        self.now, self.started, self.space = [], False, False

    def apart(self, gap: int) -> None:
        """What comes next starts a line, with an empty one before it if gap is 2."""
        self.end_line()
        self.gap = max(self.gap, gap)

    def text(self, text: str) -> None:
        words = SPACES.sub(" ", text)
        if words == " ":
            self.space = self.started
            return
        if words[0] == " ":
            self.space, words = self.started, words[1:]
        after = words[-1:] == " "
        if after:
            words = words[:-1]
        if words:
            self._start()
            if self.space:
                self.now.append(" ")
            self.now.append(words)
        self.space = after and self.started

    def kept(self, text: str) -> None:
        for k, line in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if k:
                self.forced()
            if line:
                self._start()
                self.now.append(line)

    def forced(self) -> None:
        """A line break that shows even on an empty line."""
        self._start()
        self.end_line()

    def block(self, lines: list[str]) -> None:
        for line in lines:
            self._start()
            self.now.append(line)
            self.end_line()

    def done(self) -> list[str]:
        self.end_line()
        out = self.lines
        while out and not out[-1].strip():
            out.pop()
        return out


class Table:
    """Cells of a table, by row and column. Only columns in which some cell starts are laid out."""

    def __init__(self) -> None:
        self.rows: list[dict[int, list[str]]] = []
        self.next = 0  # the column behind the last cell
        self.taken: dict[int, int] = {}  # of columns that a cell above spans: the row that is free again

    def row(self) -> None:
        self.rows.append({})
        self.next = 0

    def add(self, cell: list[str], columns: int, rows: int) -> None:
        at = len(self.rows) - 1
        while self.taken.get(self.next, 0) > at:
            self.next += 1
        self.rows[-1][self.next] = cell
        if rows > 1:
            for k in range(self.next, self.next + columns):
                self.taken[k] = at + rows
        self.next += columns

    def lines(self) -> list[str]:
        widths: dict[int, int] = {}
        for row in self.rows:
            for k, cell in row.items():
                widths[k] = max(widths.get(k, 0), min(WIDEST, max(map(len, cell), default=0)))
        columns = sorted(widths)
        out = []
        for row in self.rows:
            upto = [k for k in columns if k <= max(row, default=-1)]
            for y in range(max(map(len, row.values()), default=0)):
                parts = [(cell[y] if y < len(cell := row.get(k, [])) else "").ljust(widths[k]) for k in upto]
                out.append("  ".join(parts).rstrip(" "))
        return out


class Open:
    """An open element."""

    __slots__ = ("count", "flow", "hidden", "indented", "pre", "seen", "spans", "table", "tag")

    def __init__(self, tag: str, hidden: bool, seen: bool, pre: bool) -> None:
        self.tag, self.hidden, self.seen, self.pre = tag, hidden, seen, pre
        self.spans = (1, 1)  # columns and rows of a cell
        self.flow: Flow | None = None  # a cell's own
        self.table: Table | None = None
        self.count: int | None = None  # of an ordered list
        self.indented = False


class Renderer:
    def __init__(self, rules: Rules | None = None) -> None:
        self.rules = rules
        self.flows = [Flow()]
        self.tables: list[Table] = []
        self.stack: list[Open] = []
        self.open: dict[str, int] = {}

    def start(self, tag: str, rest: str) -> None:
        if self.open.get("p") and tag in ENDS_P:
            self.close_within("p", SCOPE)
        if tag in IMPLIED:
            names, stops = IMPLIED[tag]
            self.close_through(names, stops)
        if tag in ("td", "th") and self.tables and not self.tables[-1].rows:
            self.tables[-1].row()
        top = self.stack[-1] if self.stack else None
        hidden, seen = bool(top and top.hidden) or tag in UNSEEN, top is None or top.seen
        found = {}
        if rest and not hidden and not rest.isspace():
            for m in ATTRIBUTE.finditer(rest):
                found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        if not hidden:
            says = self.rules.says(tag, found) if self.rules else {}
            if "style" in found:
                says = says | declared(found["style"])
            hidden = "hidden" in found or says.get("display") == "none"
            if "visibility" in says:
                seen = says["visibility"] not in ("hidden", "collapse") and (says["visibility"] != "inherit" or seen)
        if tag == "br":
            if not hidden and seen:
                self.flows[-1].forced()
            return
        if tag in VOID:
            if tag == "hr" and not hidden:
                self.flows[-1].apart(1)
            return
        own = Open(tag, hidden, seen, bool(top and top.pre) or tag in ("pre", "textarea", "listing", "xmp"))
        self.stack.append(own)
        self.open[tag] = self.open.get(tag, 0) + 1
        if hidden:
            return
        flow = self.flows[-1]
        if tag in BLOCKS and tag not in ("td", "th"):
            inner = tag in ("ul", "ol", "menu", "dir", "dl") and any(self.open.get(x) for x in ("li", "dd"))
            flow.apart(2 if tag in APART and not inner else 1)
        if tag in ("ol", "ul", "menu", "dir"):
            first = found.get("start", "1")
            own.count = int(first) if tag == "ol" and re.fullmatch(r"-?\d{1,9}", first) else 1 if tag == "ol" else None
        elif tag == "li":
            above = next((x for x in reversed(self.stack[:-1]) if x.tag in ("ol", "ul", "menu", "dir")), None)
            mark = "* "
            if above is not None and above.count is not None:
                mark = f"{above.count}. "
                above.count += 1
            flow.indents.append(" " * len(mark))
            flow.mark, own.indented = mark, True
        elif tag in ("dd", "blockquote"):
            flow.indents.append("> " if tag == "blockquote" else "  ")
            own.indented = True
        elif tag == "table":
            own.table = Table()
            self.tables.append(own.table)
        elif tag == "tr" and self.tables:
            self.tables[-1].row()
        elif tag in ("td", "th") and self.tables:
            own.flow = Flow()
            number = lambda name, most: min(most, int(x)) if re.fullmatch(r"\d{1,9}", x := found.get(name, "1").strip()) else 1
            own.spans = (max(1, number("colspan", MOST_COLUMNS)), number("rowspan", MOST_ROWS) or MOST_ROWS)
            self.flows.append(own.flow)

    def pop(self) -> None:
        own = self.stack.pop()
        self.open[own.tag] -= 1
        if own.hidden:
            return
        if own.flow is not None:
            self.flows.pop()
            self.tables[-1].add(own.flow.done(), *own.spans)
            return
        flow = self.flows[-1]
        if own.table is not None:
            self.tables.pop()
            flow.block(own.table.lines())
        if own.tag in BLOCKS:
            inner = own.tag in ("ul", "ol", "menu", "dir", "dl") and any(self.open.get(x) for x in ("li", "dd"))
            flow.apart(2 if own.tag in APART and not inner else 1)
        if own.indented:
            flow.indents.pop()
            if own.tag == "li":
                flow.mark = None

    def close_through(self, names: frozenset[str], stops: frozenset[str]) -> None:
        """End all that is open up to the outermost of the names, unless a stop lies before it."""
        last = None
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag in stops:
                break
            if self.stack[k].tag in names:
                last = k
        if last is not None:
            while len(self.stack) > last:
                self.pop()

    def close_within(self, tag: str, stops: frozenset[str]) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == tag:
                while len(self.stack) > k:
                    self.pop()
                return
            if self.stack[k].tag in stops:
                return

    def end(self, tag: str) -> None:
        if tag in ("br", "p") and not self.open.get(tag):
            self.start(tag, "")
            if tag == "p":
                self.pop()
            return
        if not self.open.get(tag):
            return
        stops = frozenset(["table"]) if tag in ("tr", "td", "th", "tbody", "thead", "tfoot", "caption") else frozenset() if tag in SCOPE or tag == "body" else SCOPE
        self.close_within(tag, stops)

    def text(self, text: str) -> None:
        top = self.stack[-1] if self.stack else None
        if top is not None:
            if top.hidden or not top.seen:
                return
            if top.tag in ("table", "tr", "tbody", "thead", "tfoot") and text.isspace():
                return
        if "&" in text:
            text = html.unescape(text)
        if text:
            (self.flows[-1].kept if top is not None and top.pre else self.flows[-1].text)(text)

    def done(self) -> str:
        while self.stack:
            self.pop()
        return "\n".join(self.flows[0].done())


def render(page: str) -> str:
    """The visible text of a page."""
    page = page.replace("\0", "")
    out, at, size = Renderer(Rules(page) if "<style" in page.lower() else None), 0, len(page)
    while at < size:
        found = page.find("<", at)
        if found < 0:
            out.text(page[at:])
            break
        if found > at:
            out.text(page[at:found])
        m = TOKEN.match(page, found) or LOOSE.match(page, found)
        if m is None:
            stop = page.find("<", found + 1)  # a lone < is text
            unfinished = re.match(r"</?[a-zA-Z]", page[found : found + 3])
            if unfinished:
                break
            stop = size if stop < 0 else stop
            out.text(page[found:stop])
            at = stop
            continue
        at = m.end()
        if m[0][1] in "!?" or m.lastindex is None:
            continue
        tag = m[2].lower()
        if m[1]:
            out.end(tag)
            continue
        out.start(tag, m[3])
        if tag in RAW or tag in ESCAPABLE:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            stop = close.start() if close else size
            body = page[at:stop]
            if tag == "textarea":
                out.text(body.removeprefix("\n"))
            if out.stack and out.stack[-1].tag == tag:
                out.pop()
            at = close.end() if close else size
    return out.done()


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, text and n_chars of each page."""
    kind = dict(pages.dtypes)[id_col]

    def extract(batches):
        for part in sliced(batches, 1):
            texts = [render(x or "") for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, "text", "n_chars"])

    return on_texts(pages.select(F.col(id_col), F.col(html_col)), extract, f"`{id_col}` {kind}, text string, n_chars long")
