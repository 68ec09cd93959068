"""Links and anchors of Markdown texts: a CommonMark reader for what a graph needs of a page.

Blocks are found line by line, then each run of inline text is read once from left to right. Tables,
footnotes and emphasis need no structure here: their text is text. Python sees a page once, in Arrow
batches, and gives back its links and anchors together.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
_ATX = re.compile(r"^ {0,3}#{1,6}(?:[ \t]+|$)")
_SETEXT = re.compile(r"^ {0,3}(?:=+|-+)[ \t]*$")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"^( {0,3})(?:[-+*]|\d{1,9}[.)])(?:[ \t]+|$)")
_QUOTE = re.compile(r"^ {0,3}> ?")
_DEFINITION = re.compile(r"^ {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(?:<([^<>\n]*)>|(\S+))[ \t]*(?:(?:\"[^\"]*\"|'[^']*'|\([^()]*\))[ \t]*)?$")
_URI = re.compile(r"<([A-Za-z][A-Za-z0-9+.\-]{1,31}:[^\s<>]*)>")
_EMAIL = re.compile(r"<[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*>")
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?>|<!--.*?-->|<\?.*?\?>|<![A-Z][^>]*>", re.S)
_BLOCK_TAG = re.compile(
    r"^ {0,3}</?(?:address|article|aside|base|blockquote|body|center|col|dd|details|dialog|dir|div|dl|dt|fieldset|figure|footer|form|"
    r"frame|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|nav|ol|optgroup|option|p|param|section|summary|table|tbody|"
    r"td|tfoot|th|thead|title|tr|track|ul)(?:\s|/?>|$)", re.I,
)
_RAW_TAG = re.compile(r"^ {0,3}<(script|pre|style|textarea)(?:\s|>|$)", re.I)
_WHOLE_TAG = re.compile(rf"^ {{0,3}}(?:{_TAG.pattern})[ \t]*$", re.S)
_ANCHOR = re.compile(r"<a(?=[\s/>])", re.I)
_ATTRIBUTE = re.compile(r"\s*/?\s*([^\s=>/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")


@dataclass
class Page:
    links: list[tuple[str, int]] = field(default_factory=list)
    anchors: list[str] = field(default_factory=list)


def metadata_end(text: str) -> int | None:
    """Where a leading metadata block ends (its last fence included), None if there is none.

    It opens at the very start with ``---`` alone, its first line is neither blank nor a closing fence,
    and it closes at ``---`` or ``...`` followed by nothing but spaces.
    """
    opening = re.match(r"---[ \t\x0b\x0c]*\r?\n", text)
    if not opening:
        return None
    at = opening.end()
    first = True
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        line = text[at:stop].removesuffix("\r")
        closes = re.fullmatch(r"(?:---|\.\.\.) *", line) is not None
        if first and (closes or not line.strip(" \t\x0b\x0c")):
            return None
        if closes:
            return stop
        first, at = False, stop + 1
    return None


def mask_metadata(text: str) -> str:
    """The text with its metadata block blanked, line ends kept, so that lines keep their numbers."""
    end = metadata_end(text)
    return text if end is None else re.sub(r"[^\r\n]", " ", text[:end]) + text[end:]


def slug(text: str) -> str:
    out = []
    for c in text:
        if c == " ":
            out.append("-")
        elif c in "-_" or c.isalnum() or unicodedata.category(c)[0] in "LNM":
            out.append(c.lower())
    return "".join(out)


class Slugger:
    """Anchors of a page's headings: a repeated one takes the next free number."""

    def __init__(self) -> None:
        self.taken: dict[str, int] = {}

    def anchor(self, text: str) -> str:
        base = slug(text)
        name, n = base, self.taken.get(base, 0)
        while name in self.taken:
            n += 1
            name = f"{base}-{n}"
        self.taken[base] = n
        self.taken.setdefault(name, 0)
        return name


def html_anchors(html: str) -> list[str]:
    """``id`` and ``name`` of ``<a>`` tags, as written; the first of a repeated attribute counts."""
    out = []
    for tag in _ANCHOR.finditer(html):
        at, seen = tag.end(), {}
        while True:
            m = _ATTRIBUTE.match(html, at)
            if not m:
                break
            value = next((g for g in m.groups()[1:] if g is not None), None)
            seen.setdefault(m[1].lower(), value)
            at = m.end()
        if re.match(r"\s*/?\s*>", html[at:]):  # else a quote was left open: no tag
            out += [seen[k] for k in ("id", "name") if seen.get(k)]
    return out


def _label(text: str) -> str:
    return re.sub(r"\s+", " ", text.strip()).casefold()


def _unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def _destination(text: str, at: int) -> tuple[str, int] | None:
    """A link's ``(destination "title")`` from its opening bracket: the destination and where it ends."""
    m = re.compile(r"\(\s*").match(text, at)
    if not m:
        return None
    at = m.end()
    angle = re.compile(r"<((?:[^<>\n\\]|\\.)*)>").match(text, at)
    if angle:
        dest, at = angle[1], angle.end()
    else:
        start, depth = at, 0
        while at < len(text) and not text[at].isspace() and ord(text[at]) > 31:
            c = text[at]
            if c == "\\" and at + 1 < len(text):
                at += 2
                continue
            if c == "(":
                depth += 1
            elif c == ")":
                if not depth:
                    break
                depth -= 1
            at += 1
        if depth:
            return None
        dest = text[start:at]
    m = re.compile(r"\s*(?:\s(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\))\s*)?\)", re.S).match(text, at)
    return (_unescape(dest), m.end()) if m else None


def read_inline(text: str, offset: int, defined: dict[str, str], links: list[tuple[int, str]], html: list[tuple[int, str]]) -> str:
    """Read one run of inline text: links by their offset, raw HTML by its, and the rendered text as result."""
    shown: list[str] = []  # pieces; an open bracket is a piece of its own
    open_: list[dict] = []
    at, n = 0, len(text)
    while at < n:
        c = text[at]
        if c == "\\" and at + 1 < n:
            shown.append(text[at + 1] if _ESCAPE.match(text, at) else text[at : at + 2])
            at += 2
        elif c == "`":
            run = re.compile("`+").match(text, at)[0]
            close = re.compile(rf"(?<!`){run}(?!`)").search(text, at + len(run))
            if close:
                inner = text[at + len(run) : close.start()].replace("\n", " ")
                shown.append(inner[1:-1] if inner[:1] == inner[-1:] == " " and inner.strip() else inner)
                at = close.end()
            else:
                shown.append(run)
                at += len(run)
        elif c == "<":
            m = _URI.match(text, at)
            if m:
                links.append((offset + at, m[1]))
                shown.append(m[1])
            else:
                m = _EMAIL.match(text, at)
                if m:
                    shown.append(m[0][1:-1])
                else:
                    m = _TAG.match(text, at)
                    if m:
                        html.append((offset + at, m[0]))
            if m:
                at = m.end()
            else:
                shown.append(c)
                at += 1
        elif c == "[" or c == "!" and text[at + 1 : at + 2] == "[":
            image = c == "!"
            open_.append({"image": image, "at": at, "piece": len(shown), "live": True, "links": len(links)})
            shown.append("![" if image else "[")
            at += 1 + image
        elif c == "]" and open_:
            top = open_.pop()
            start = top["at"] + 1 + top["image"]
            found = None
            if top["live"]:
                found = _destination(text, at + 1)
                if found is None:
                    ref = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]").match(text, at + 1)
                    label = ref[1] if ref and ref[1].strip() else text[start:at]
                    dest = defined.get(_label(label))
                    if dest is None and not ref:
                        label = text[start:at]
                    if dest is not None:
                        found = (dest, ref.end() if ref else at + 1)
            if found is None:
                shown.append("]")
                at += 1
            else:
                links.append((offset + top["at"], found[0]))
                if top["image"]:
                    del shown[top["piece"] :]  # what an image is called is not shown
                else:
                    shown[top["piece"]] = ""
                    for other in open_:  # links do not nest
                        if not other["image"]:
                            other["live"] = False
                at = found[1]
        elif c in "*~":
            at += 1
        elif c == "_" and not (at and text[at - 1].isalnum() and text[at + 1 : at + 2].isalnum()):
            at += 1
        else:
            stop = re.compile(r"[\\`<\[\]!*_~]").search(text, at + 1)
            stop = stop.start() if stop else n
            shown.append(text[at:stop])
            at = stop
    return "".join(shown)


def _blocks(text: str):
    """Blocks in order: ('text' | 'heading' | 'html', offset, content) with container marks blanked out.

    Contents keep their length line by line, so that offsets stay true.
    """
    pending: list[str] = []
    start = 0
    fence = None
    html_end = None
    html_lines: list[str] = []
    html_start = 0
    list_indent = 0
    at = 0

    def flush(kind="text"):
        nonlocal pending
        if pending:
            yield kind, start, "".join(pending)
        pending = []

    for whole in text.splitlines(keepends=True) if "\x0b" not in text and "\x0c" not in text and "\x85" not in text and "\u2028" not in text else re.findall(r"[^\n]*\n|[^\n]+$", text):
        line = whole.rstrip("\r\n")
        here, at = at, at + len(whole)
        body, pad = line.expandtabs(4) if "\t" in line[:8] else line, 0
        if len(body) != len(line):
            body = line  # offsets first: a tab counts as one column
        if fence:
            inner = body.lstrip(" >") if fence[2] else body
            m = _FENCE.match(inner[min(list_indent, len(inner) - len(inner.lstrip())) :])
            if m and m[1][0] == fence[0] and len(m[1]) >= fence[1] and not m[2].strip():
                fence = None
            continue
        if html_end is not None:
            html_lines.append(whole)
            if html_end == "" and not body.strip() or html_end and html_end in body.lower():
                yield "html", html_start, "".join(html_lines)
                html_end = None
            continue
        quoted = False
        while True:
            m = _QUOTE.match(body[pad:])
            if m:
                quoted = True
                pad += m.end()
                continue
            m = _ITEM.match(body[pad:])
            if m and not _RULE.match(body[pad:]):
                if pending:
                    yield from flush()
                list_indent = m.end()
                pad += m.end()
                continue
            break
        rest = body[pad:]
        indent = len(rest) - len(rest.lstrip(" "))
        if not pad and list_indent and indent >= min(list_indent, 2) and rest.strip():
            cut = min(indent, list_indent)
            pad, rest, indent = cut, rest[cut:], indent - cut
        elif not pad and rest.strip() and indent == 0 and not pending:
            list_indent = 0
        if not rest.strip():
            yield from flush()
            continue
        if indent >= 4 and not pending or rest.startswith("\t") and not pending:
            continue  # indented code
        m = _FENCE.match(rest)
        if m and not (m[1][0] == "`" and "`" in m[2]):
            yield from flush()
            fence = (m[1][0], len(m[1]), quoted)
            continue
        blank = " " * pad
        if _ATX.match(rest):
            yield from flush()
            lead = _ATX.match(rest).end()
            content = re.sub(r"(?:^|[ \t]+)#+[ \t]*$", "", rest[lead:])
            yield "heading", here + pad + lead, content
            continue
        if pending and _SETEXT.match(rest) and not quoted:
            yield from flush("heading")
            continue
        if _RULE.match(rest):
            yield from flush()
            continue
        raw = _RAW_TAG.match(rest)
        if raw or rest.lstrip().startswith("<!--") or _BLOCK_TAG.match(rest) or (not pending and _WHOLE_TAG.match(rest)):
            yield from flush()
            ends = f"</{raw[1].lower()}>" if raw else "-->" if rest.lstrip().startswith("<!--") else ""
            if ends and ends in rest.lower():
                yield "html", here, whole
            else:
                html_end, html_lines, html_start = ends, [blank + whole[pad:]], here
            continue
        if not pending:
            start = here
        pending.append(blank + whole[pad:])
    if html_end is not None:
        yield "html", html_start, "".join(html_lines)
    yield from flush()


def parse(text: str) -> Page:
    """All links (target as written, line) and anchors of a page, in order of appearance."""
    text = mask_metadata(text)
    blocks, defined = [], {}
    for kind, offset, content in _blocks(text):
        if kind == "text":
            lines = content.splitlines(keepends=True)
            while lines:
                m = _DEFINITION.match(lines[0].rstrip("\r\n"))
                if not m:
                    break
                defined.setdefault(_label(m[1]), _unescape(m[2] if m[2] is not None else m[3]))
                offset += len(lines.pop(0))
            content = "".join(lines)
        if content.strip():
            blocks.append((kind, offset, content))
    newlines = [i for i, c in enumerate(text) if c == "\n"]
    page, slugs = Page(), Slugger()
    for kind, offset, content in blocks:
        if kind == "html":
            page.anchors += html_anchors(content)
            continue
        links: list[tuple[int, str]] = []
        html: list[tuple[int, str]] = []
        shown = read_inline(content, offset, defined, links, html)
        page.links += [(target, bisect_right(newlines, at - 1) + 1 if at else 1) for at, target in sorted(links, key=lambda x: x[0])]
        for _, tag in html:
            page.anchors += html_anchors(tag)
        if kind == "heading":
            page.anchors.append(slugs.anchor(shown.strip()))
    page.anchors = [a for a in dict.fromkeys(page.anchors) if a]
    return page


def parse_pages(pages: DataFrame) -> DataFrame:
    """``path, links array<struct<target, line>>, anchors``: one row for each page (path, text); null texts have nulls."""
    kind = pa.list_(pa.struct([("target", pa.string()), ("line", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [None if t is None else parse(t) for t in batch.column(1).to_pylist()]
            links = [None if p is None else [{"target": t, "line": n} for t, n in p.links] for p in read]
            anchors = [None if p is None else p.anchors for p in read]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(links, kind), pa.array(anchors, pa.list_(pa.string()))], names=["path", "links", "anchors"]
            )

    return pages.select("path", "text").mapInArrow(run, "path string, links array<struct<target:string,line:bigint>>, anchors array<string>")
