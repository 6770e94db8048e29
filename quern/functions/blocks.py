"""The block structure of Markdown, read line by line with a stack of containers.

scan() gives the top-level blocks of a text and its leaves at any depth. Only what decides
where blocks begin and end is read here; inline markup is left to Column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

_LINE = re.compile(r"[^\n]*\n|[^\n]+")
_RULE = re.compile(r"([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_HEADING = re.compile(r"(#{1,6})(?:[ \t]+|$)")
_FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
_MARKER = re.compile(r"(?:([-+*])|(\d{1,9})([.)]))(?=[ \t]|$)")
_UNDERLINE = re.compile(r"(=+|-+)[ \t]*$")
_DELIMITERS = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_CELL = re.compile(r"(?<!\\)\|")
#: Elements that begin an HTML block by themselves: fixed values of CommonMark.
_ELEMENTS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p "
    "param search section summary table tbody td tfoot th thead title tr track ul"
).split()
_ATTRIBUTE = r"""(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+))?)*\s*"""
#: How an HTML block begins, and what ends it (None: a blank line).
_HTML = [
    (re.compile(r"<(?:script|pre|style|textarea)(?=[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile("-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(r"<![A-Za-z]"), re.compile(">")),
    (re.compile(rf"</?(?:{'|'.join(_ELEMENTS)})(?=[\s>]|/>|$)", re.I), None),
]
_TAG_LINE = re.compile(rf"(?:<[A-Za-z][A-Za-z0-9-]*{_ATTRIBUTE}/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$")


@dataclass
class Leaf:
    kind: str
    level: int = 0
    depth: int = 0
    parts: list[tuple[int, int]] = field(default_factory=list)

    def shown(self, text: str) -> str:
        """The leaf's source from its first to its last character; what belongs to containers is blank."""
        out, at = [], self.parts[0][0]
        for a, b in self.parts:
            out += [" " * (a - at), text[a:b]]
            at = b
        return "".join(out)


def _ahead(line: str, at: int, col: int) -> tuple[int, int]:
    """Where the next character that is no blank stands, and its column."""
    while at < len(line) and line[at] in " \t":
        col += 1 if line[at] == " " else 4 - col % 4
        at += 1
    return at, col


def _skip(line: str, at: int, col: int, width: int) -> tuple[int, int]:
    end = col + width
    while col < end and at < len(line) and line[at] in " \t":
        col += 1 if line[at] == " " else 4 - col % 4
        at += 1
    return at, col


def _html_start(rest: str, in_paragraph: bool):
    for opens, ends in _HTML:
        if opens.match(rest):
            return True, ends
    return not in_paragraph and bool(_TAG_LINE.match(rest)), None


def scan(text: str) -> tuple[list[tuple[int, str]], list[Leaf]]:
    """(start, kind) of each top-level block, and the leaves: paragraph, heading, code, html, table and break.

    A table has a header row of one line; a container that ends ends what is open in it,
    but for a paragraph that goes on without its markers.
    """
    tops: list[tuple[int, str]] = []
    leaves: list[Leaf] = []
    stack: list[tuple[str, int]] = []  # ('>', 0) or (marker, columns that an item's content is indented by)
    leaf: Leaf | None = None
    closing = ends = None

    def begin(kind: str, start: int, level: int = 0) -> Leaf:
        if not stack:
            tops.append((start, kind))
        leaves.append(Leaf(kind, level, len(stack)))
        return leaves[-1]

    for m in _LINE.finditer(text):
        base, end = m.span()
        line = m[0].rstrip("\r\n")
        at = col = depth = 0
        for mark, width in stack:
            p, c = _ahead(line, at, col)
            if mark == ">":
                if c - col > 3 or line[p : p + 1] != ">":
                    break
                at, col = _skip(line, p + 1, c + 1, 1)
            elif p == len(line):
                at, col = p, c
            elif c - col >= width:
                at, col = _skip(line, at, col, width)
            else:
                break
            depth += 1
        inside = depth == len(stack)
        p, c = _ahead(line, at, col)
        blank = p == len(line)
        if leaf and leaf.kind in ("code", "html"):
            if inside and closing is not None:  # a fence
                leaf.parts.append((base + at, end))
                if c - col <= 3 and closing.match(line, p):
                    leaf = closing = None
                continue
            if inside and leaf.kind == "html" and (ends or not blank):
                leaf.parts.append((base + at, end))
                if ends and ends.search(line, at):
                    leaf = None
                continue
            if inside and leaf.kind == "code" and (blank or c - col >= 4):
                leaf.parts.append((base + at, end))
                continue
            leaf = closing = None
        opened = False
        while not blank and c - col < 4:
            marker = None if _RULE.match(line, p) else _MARKER.match(line, p)
            if line[p] == ">":
                kind, width, after, col_after = ">", 0, *_skip(line, p + 1, c + 1, 1)
            elif marker:
                q, d = _ahead(line, marker.end(), c + len(marker[0]))
                empty = q == len(line)
                if leaf and inside and not opened and leaf.kind == "paragraph" and (empty or (marker[2] and int(marker[2]) != 1)):
                    break
                spaces = d - c - len(marker[0])
                spaces = 1 if empty or spaces > 4 else spaces
                kind, width = marker[1] or marker[3], c - col + len(marker[0]) + spaces
                after, col_after = _skip(line, marker.end(), c + len(marker[0]), spaces)
            else:
                break
            if len(stack) > depth or not opened:
                goes_on = depth == 0 and bool(stack) and kind != ">" and stack[0][0] == kind
                del stack[depth:]
                if depth == 0 and not goes_on:
                    tops.append((base, "quote" if kind == ">" else "list"))
            stack.append((kind, width))
            depth, opened, inside, leaf = depth + 1, True, True, None
            at, col = after, col_after
            p, c = _ahead(line, at, col)
            blank = p == len(line)
        if blank:
            if not opened:
                del stack[depth:]
            leaf = None
            continue
        rest = line[p:]
        code = c - col >= 4
        in_paragraph = leaf is not None and leaf.kind == "paragraph"
        html, how = (False, None) if code else _html_start(rest, in_paragraph)
        fence = None if code else _FENCE.match(rest)
        heading = None if code else _HEADING.match(rest)
        rule = not code and _RULE.match(rest)
        if leaf and leaf.kind in ("paragraph", "table") and not opened and not (html or fence or heading):
            if inside and in_paragraph and not code and (u := _UNDERLINE.match(rest)):
                leaf.kind, leaf.level = "heading", 1 if u[1][0] == "=" else 2
                if leaf.depth == 0:
                    tops[-1] = (tops[-1][0], "heading")
                leaf.parts.append((base + p, end))
                leaf = None
                continue
            if not rule:
                if inside and in_paragraph and len(leaf.parts) == 1 and _DELIMITERS.match(rest) and "|" in text[slice(*leaf.parts[0])]:
                    cells = [len(_CELL.split(row.strip().strip("|"))) for row in (text[slice(*leaf.parts[0])], rest)]
                    if cells[0] == cells[1]:
                        leaf.kind = "table"
                if inside or in_paragraph:
                    leaf.parts.append((base + p, end))
                    continue
        if not inside:
            del stack[depth:]
        if code:
            leaf, closing = begin("code", base), None
            leaf.parts.append((base + at, end))
        elif heading:
            begin("heading", base, len(heading[1])).parts.append((base + p, end))
            leaf = None
        elif fence:
            run = fence[1] or fence[3]
            leaf, closing = begin("code", base), re.compile(rf"{re.escape(run[0])}{{{len(run)},}}[ \t]*$")
            leaf.parts.append((base + p, end))
        elif html:
            leaf, ends = begin("html", base), how
            leaf.parts.append((base + at, end))
            if ends and ends.search(rest):
                leaf = None
        elif rule:
            begin("break", base).parts.append((base + p, end))
            leaf = None
        else:
            leaf = begin("paragraph", base)
            leaf.parts.append((base + p, end))
    return tops, leaves


BLOCKS = "tops array<struct<start:int,end:int,kind:string>>, leaves array<struct<kind:string,level:int,depth:int,start:int,end:int,shown:string>>"
_LEAF = pa.struct([("kind", pa.string()), ("level", pa.int32()), ("depth", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("shown", pa.string())])
_TOP = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])


def with_blocks(df: DataFrame, key: str, text: str, prepare=None) -> DataFrame:
    """(key, text, tops, leaves) of every row; offsets count code points, and each top ends where the next begins.

    ``prepare`` may rewrite a text to one of the same length before it is scanned. Null
    texts have no blocks. Code has no ``shown``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a few rows at a time, so that what is held is bounded by the longest texts
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                tops, leaves = [], []
                for t in part.column(1).to_pylist():
                    said = prepare(t) if prepare and t else t or ""
                    top, leaf = scan(said)
                    ends = [s for s, _ in top[1:]] + [len(said)]
                    tops.append([{"start": s, "end": e, "kind": k} for (s, k), e in zip(top, ends, strict=False)])
                    leaves.append([{"kind": x.kind, "level": x.level, "depth": x.depth, "start": x.parts[0][0], "end": x.parts[-1][1], "shown": "" if x.kind == "code" else x.shown(said)} for x in leaf])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tops, pa.list_(_TOP)), pa.array(leaves, pa.list_(_LEAF))], [key, text, "tops", "leaves"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, `{text}` string, {BLOCKS}")
