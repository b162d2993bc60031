"""Markdown's blocks by the container stack of the public CommonMark specification, with tables.

Each line is held against the open containers (quotes and list items), may then open more of them, and what is left of it
goes to the innermost leaf; a line that fits no container still continues an open paragraph (a lazy line). Out come the
leaves: headings, paragraphs, the paragraph that opens a list item, code, and tables. Breaks, raw HTML and link definitions
are no blocks. Inline marks stay as they are written.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

Found = tuple[str, str, "int | None"]

_ATX = re.compile(r"(#{1,6})(?:[ \t]+(.*?))?(?:(?<=[ \t])#+|)[ \t]*$")
_SETEXT = re.compile(r"(=+|-+)[ \t]*$")
_BREAK = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|(?:-[ \t]*){3,})$")
_FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
_MARKER = re.compile(r"(?:([-+*])|(\d{1,9})([.)]))(?=[ \t]|$)")
_DELIMITERS = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_DEFINITION = re.compile(r"\[(?!\s*\])(?:[^\[\]\\]|\\.){1,999}\]:\s*(?:<[^<>\n]*>|[^\s<]\S*)(?:[ \t]*\n?[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*(?:\n|$)")
#: Fixed values of the specification: elements whose tags open a block of raw HTML that ends at a blank line.
_HTML_BLOCKS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
).split()
_HTML = (
    (re.compile(r"<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"</?(?:{'|'.join(_HTML_BLOCKS)})(?:\s|/?>|$)", re.I), None),
)
_ANY_TAG = re.compile(r"(?:<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)[ \t]*$")


def _indent(s: str, column: int) -> int:
    """Columns of white space at the start of what stands at a column."""
    at = column
    for c in s:
        if c == " ":
            at += 1
        elif c == "\t":
            at += 4 - at % 4
        else:
            break
    return at - column


def _without(s: str, column: int, n: int) -> tuple[str, int]:
    """s without n columns of white space, and where it stands then; what a tab has beyond them stays as spaces."""
    end = column + n
    while s and column < end and s[0] in " \t":
        step = 1 if s[0] == " " else 4 - column % 4
        s, column = s[1:], column + step
        if column > end:
            return " " * (column - end) + s, end
    return s, column


class _Item:
    """A list item (its content's indent) or, without one, a quote; and how many blocks it has."""

    def __init__(self, indent: int | None) -> None:
        self.indent, self.blocks, self.blank = indent, 0, False


class _Reader:
    def __init__(self) -> None:
        self.open: list[_Item] = []
        self.kind: str | None = None  # the open leaf: paragraph, fenced, indented, html, table
        self.lines: list[str] = []
        self.first = False  # whether the leaf is its item's first block
        self.fence: tuple[str, int, int] = ("", 0, 0)
        self.ends: re.Pattern | None = None
        self.out: list[Found] = []

    def begin(self, kind: str, *lines: str) -> None:
        self.close()
        self.kind, self.lines = kind, list(lines)
        self.first = bool(self.open) and self.open[-1].indent is not None and self.open[-1].blocks == 0
        self.counted()

    def counted(self) -> None:
        if self.open:
            self.open[-1].blocks += 1

    def close(self) -> None:
        kind, lines, self.kind, self.lines = self.kind, self.lines, None, []
        if kind == "paragraph":
            text = self.text_of(lines)
            if text:
                self.out.append(("list_item" if self.first else "paragraph", text, None))
        elif kind in ("fenced", "indented"):
            if kind == "indented":
                while lines and not lines[-1].strip():
                    lines.pop()
            self.out.append(("code", "\n".join(lines), None))
        elif kind == "table":
            rows = [_cells(x) for x in lines]
            self.out.append(("table", "\n".join(" | ".join((r + [""] * len(rows[0]))[: len(rows[0])]) for r in rows), None))

    def text_of(self, lines: list[str]) -> str:
        """A paragraph's text without the link definitions that it begins with."""
        text = "\n".join(lines)
        while m := _DEFINITION.match(text):
            text = text[m.end() :]
        return text.strip()

    def heading(self, text: str, level: int) -> None:
        self.counted()
        self.out.append(("heading", text.strip(), level))

    def leave(self, depth: int) -> None:
        if depth < len(self.open):
            self.close()
            del self.open[depth:]

    def line(self, rest: str) -> None:
        column, depth = 0, 0
        for held in self.open:
            if held.indent is None:
                if _indent(rest, column) > 3 or not rest.lstrip(" \t").startswith(">"):
                    break
                rest, column = _without(rest, column, 3)
                rest, column = _without(rest[1:], column + 1, 1)
            elif not rest.strip():
                if not held.blocks and held.blank:
                    break
                held.blank = True
            elif _indent(rest, column) >= held.indent:
                rest, column = _without(rest, column, held.indent)
            else:
                break
            depth += 1
        whole = depth == len(self.open)
        if whole and self.kind == "fenced":
            mark, length, indent = self.fence
            if _indent(rest, column) <= 3 and re.fullmatch(rf"{re.escape(mark)}{{{length},}}[ \t]*", rest.lstrip(" \t")):
                self.close()
            else:
                self.lines.append(_without(rest, column, indent)[0])
            return
        if whole and self.kind == "html":
            if (self.ends is None and not rest.strip()) or (self.ends and self.ends.search(rest)):
                self.kind = None
            return
        continued = whole and self.kind == "paragraph"
        while rest.strip():
            indent, bare = _indent(rest, column), rest.lstrip(" \t")
            if indent > 3:
                break
            if bare.startswith(">"):
                self.leave(depth)
                if self.kind:
                    self.close()
                self.counted()
                self.open.append(_Item(None))
                rest, column = _without(rest, column, 3)
                rest, column = _without(rest[1:], column + 1, 1)
            elif continued and (m := _SETEXT.match(bare)) and self.text_of(self.lines):
                text, self.kind, self.lines = self.text_of(self.lines), None, []
                self.out.append(("heading", text, 1 if m[1][0] == "=" else 2))
                return
            elif self.starts_leaf(bare, indent, depth, continued):
                return
            elif (m := _MARKER.match(bare)) and not (continued and (not bare[m.end() :].strip() or (m[2] and int(m[2]) != 1))):
                self.leave(depth)
                if self.kind:
                    self.close()
                self.counted()
                column, width = column + indent + m.end(), indent + m.end()
                rest = bare[m.end() :]
                gap = _indent(rest, column)
                gap = 1 if gap > 4 or not rest.strip() else gap
                rest, column = _without(rest, column, gap)
                self.open.append(_Item(width + gap))
                self.open[-1].blank = not rest.strip()
            else:
                break
            depth, whole, continued = len(self.open), True, False
        self.leaf(rest, column, depth, whole)

    def starts_leaf(self, bare: str, indent: int, depth: int, continued: bool) -> bool:
        """Whether a heading, a fence, a break or raw HTML begins here."""
        if m := _ATX.match(bare):
            self.leave(depth)
            self.close()
            self.heading(m[2] or "", len(m[1]))
        elif m := _FENCE.match(bare):
            self.leave(depth)
            self.begin("fenced")
            mark = m[1] or m[3]
            self.fence = mark[0], len(mark), indent
        elif _BREAK.match(bare):
            self.leave(depth)
            self.close()
            self.counted()
        else:
            for start, end in _HTML:
                if start.match(bare):
                    break
            else:
                if continued or not _ANY_TAG.match(bare) or (self.kind == "paragraph" and depth < len(self.open)):
                    return False
                start, end = _ANY_TAG, None
            self.leave(depth)
            self.begin("html")
            self.ends = end
            if end and end.search(bare):
                self.kind = None
        return True

    def leaf(self, rest: str, column: int, depth: int, whole: bool) -> None:
        text = rest.strip(" \t")
        if not whole and text and self.kind == "paragraph":
            self.lines.append(text)  # a lazy line
            return
        self.leave(depth)
        if not text:
            if self.kind == "indented":
                self.lines.append(_without(rest, column, 4)[0])
            elif self.kind:
                self.close()
        elif self.kind == "paragraph":
            if _indent(rest, column) <= 3 and "|" in self.lines[-1] and _DELIMITERS.match(text) and len(_cells(text)) == len(_cells(self.lines[-1])):
                head = self.lines.pop()
                if not self.lines:
                    self.kind = None
                    self.open[-1:] and self._uncount()
                self.begin("table", head)
            else:
                self.lines.append(text)
        elif self.kind == "table" and _indent(rest, column) <= 3:
            self.lines.append(text)
        elif _indent(rest, column) > 3:
            if self.kind != "indented":
                self.begin("indented")
            self.lines.append(_without(rest, column, 4)[0])
        else:
            self.begin("paragraph", text)

    def _uncount(self) -> None:
        self.open[-1].blocks -= 1


def _cells(row: str) -> list[str]:
    parts = [p.strip() for p in re.split(r"(?<!\\)\|", row.strip())]
    if len(parts) > 1 and not parts[0]:
        parts = parts[1:]
    if len(parts) > 1 and not parts[-1]:
        parts = parts[:-1]
    return [p.replace("\\|", "|") for p in parts]


def blocks(text: str) -> Iterator[Found]:
    """kind (heading, paragraph, list_item, code, table), text, level of a text's blocks in order."""
    reader = _Reader()
    for line in re.split(r"\r\n|\n|\r", text):
        reader.line(line)
        if reader.out:
            yield from reader.out
            reader.out.clear()
    reader.close()
    yield from reader.out


def markdown(text: str, meta: dict, flags: list) -> Iterator[Found]:
    """blocks, the first heading as the title, and a flag for tables."""
    for kind, own, level in blocks(text):
        if kind == "heading":
            meta.setdefault("title", own)
        if kind == "table" and "tables_detected" not in flags:
            flags.append("tables_detected")
        yield kind, own, level
