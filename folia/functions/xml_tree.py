"""A tolerant, linear-time reader of article XML into columns: one entry per node. A small helper for one Arrow function.

Besides the tree, every node gets what later lookups need, so that they are filters and joins on equal numbers: tag of its parent
and grandparent, part of the article, level in the chain of sections, the nearest ancestor of each kind in NEAREST, and the
place of its text, in bytes, in the document's text, and where its tags stand in the source. All of it is of fixed size, so the output is linear in the input at any depth.
The outermost element of those in HOLDERS carries all text below it, if it has children; what lies deeper knows its number.
"""

from __future__ import annotations

import re
from html import unescape

#: Comments and instructions leave no node, and text runs on over them.
_TOKEN = re.compile(r"<!--(?:.*?)(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<\?.*?(?:\?>|\Z)|<!DOCTYPE[^>\[]*|<(/?)([^\s<>/!?]+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_ENTITY = re.compile(r"&(#\d+|#x[0-9a-fA-F]+|[a-zA-Z][\w.]*);")
_SPACE = re.compile(r"\s*")
_STRICT = frozenset(("amp", "lt", "gt", "quot", "apos"))


def local_name(name: str) -> str:
    return name.rpartition(":")[2]


def _text(raw: str) -> str:
    return unescape(raw) if "&" in raw else raw


#: Nearest proper ancestors that a node knows: column and tag.
NEAREST = {"sec_id": "sec", "contrib_id": "contrib", "fig_id": "fig", "wrap_id": "table-wrap", "grid_id": "table", "row_id": "tr", "para_id": "p", "ref_id": "ref", "corresp_id": "corresp"}
_PLACE = {tag: k for k, tag in enumerate(NEAREST.values())}
_NOWHERE = (-1,) * len(NEAREST)
#: Parts of an article: a node's region is the nearest of them above it.
REGIONS = frozenset(("article-meta", "journal-meta", "body", "back"))
#: Elements whose whole text is asked for: a byte of the document's text is kept once more at most, in the outermost of them.
HOLDERS = frozenset("""article-title trans-title translated-title journal-title publisher-name volume issue fpage lpage elocation-id article-id day month year kwd
    aff email corresp surname given-names collab contrib-id label title caption th td""".split())
_FIXED = ("node_id", "parent_id", "ordinal", "depth", "sec_level", "text_from", "src_from", "tag", "ns", "parent_tag", "parent_ns", "grand_tag", "region", *NEAREST, "holder_id")
_LATER = ("end_id", "text_to", "src_close", "src_to", "src_tail", "text", "tail", "content", "inner")  # known when more of the document is read
STRINGS = ("tag", "ns", "parent_tag", "parent_ns", "grand_tag", "region", "text", "tail")
INTS = tuple(c for c in (*_FIXED, *_LATER) if c not in (*STRINGS, "content", "inner"))


class Columns:
    """Nodes of many documents by column; ``document_starts`` has the first node of each, ``attribute_starts`` of each node's attributes."""

    def __init__(self):
        self.fixed: list[tuple] = []
        self.later: dict[str, list] = {name: [] for name in _LATER}
        self.children: list[list[str]] = []  # full names of each node's children
        self.loose: list[bool] = []  # whether text other than white space stands between them
        self.keys: list[str] = []
        self.values: list[str] = []
        self.attribute_starts, self.document_starts = [0], [0]

    def lists(self) -> dict[str, list]:
        fixed = map(list, zip(*self.fixed)) if self.fixed else [[] for _ in _FIXED]
        return dict(zip(_FIXED, fixed)) | self.later

    def rows(self) -> list[dict]:
        columns = self.lists()
        at = self.attribute_starts
        attrs = [list(zip(self.keys[a:b], self.values[a:b])) for a, b in zip(at, at[1:])]
        return [dict(zip((*columns, "attrs", "children", "loose"), row)) for row in zip(*columns.values(), attrs, self.children, self.loose)]


def read(xml: str | None) -> tuple[list[dict], str | None]:
    """Nodes in document order, and the first error that had to be repaired (None for well-formed input)."""
    out = Columns()
    error = read_into(out, xml)
    return out.rows(), error


def read_into(out: Columns, xml: str | None) -> str | None:
    """Adds a document's nodes to the columns and returns the first error that had to be repaired."""
    base = len(out.fixed)
    try:
        return _read(out, base, xml)
    finally:
        out.document_starts.append(len(out.fixed))


def _read(out: Columns, base: int, xml: str | None) -> str | None:
    if xml is None or not xml.strip():
        return "empty document"
    nodes = out.fixed
    ends, until, closing, closed, tailed, texts, tails, contents, inners = (out.later[c] for c in _LATER)
    content: list[bytes] = []  # the document's text so far
    length = 0
    error: list[str] = []
    stack: list[int] = []
    names: list[str] = []  # names of the open elements, prefixes included
    pieces: list[str] = []
    counts: list[int] = []  # children so far, per open element
    inner: list[tuple] = []  # nearest ancestors of the children, per open element
    last = -1  # the node that closed last below the top of the stack, which text is the tail of
    held = piece = -1  # the outermost open element of HOLDERS, and where its text starts in content

    def fail(what: str, at: int) -> None:
        if not error:
            error.append(f"{what} at {at}")

    def decoded(start: int, end: int) -> str:
        raw = xml[start:end]
        if "<" in raw:
            fail("bare <", start)
        if "&" not in raw:
            return raw
        if raw.count("&") > sum(e[1][0] == "#" or e[1] in _STRICT for e in _ENTITY.finditer(raw)):
            fail("undefined entity", start)
        return unescape(raw)

    def flush(here: int) -> None:
        nonlocal length
        if pieces:
            text = "".join(pieces)
            pieces.clear()
            if stack:
                raw = text.encode("utf-8", "replace")
                content.append(raw)
                if not text.isspace():
                    out.loose[base + stack[-1]] = True
                length += len(raw)
                if last >= 0:
                    tails[base + last] += text
                    tailed[base + last] = here
                else:
                    texts[base + stack[-1]] += text
            elif text.strip():
                fail("text outside the root", 0)

    def close(start: int, end: int) -> None:
        nonlocal last, held
        flush(start)
        k = stack.pop()
        if k == held:
            if len(nodes) > base + k + 1:
                inners[base + k] = b"".join(content[piece:])
            held = -1
        names.pop()
        counts.pop()
        inner.pop()
        ends[base + k] = len(nodes) - base - 1
        until[base + k] = length
        closing[base + k], closed[base + k], tailed[base + k] = start, end, end
        last = k

    at = subset = 0
    while True:
        m = _TOKEN.search(xml, at)
        until_here = m.start() if m else len(xml)
        if until_here > at:
            pieces.append(decoded(at, until_here))
        if not m:
            break
        at = m.end()
        if m[1] is not None:
            pieces.append(m[1])
            continue
        if m[3] is None:
            if m.group().startswith("<!DOCTYPE"):
                if xml.startswith("[", at):  # an internal subset; once one has no end, none after it has
                    subset = xml.find("]", at) if subset >= 0 else -1
                    after = _SPACE.match(xml, subset + 1).end() if subset >= 0 else at
                else:
                    after = at
                if xml.startswith(">", after):
                    at = after + 1
                else:
                    fail("doctype without end", m.start())
            elif m.group().startswith("<!--") and not m.group().endswith("-->"):
                fail("comment without end", m.start())
            continue
        name = m[3]
        if m[2]:
            if names and names[-1] == name:
                close(m.start(), m.end())
            elif name in names:
                fail(f"mismatched end tag {name}", m.start())
                while names[-1] != name:
                    close(m.start(), m.start())
                close(m.start(), m.end())
            else:
                fail(f"end tag {name} without start", m.start())
            continue
        flush(m.start())
        rest = m[4]
        empty = rest.endswith("/")
        if not stack and len(nodes) > base:
            fail("second root", m.start())
        if rest:
            attributes = {local_name(a): _text(b or c or "") for a, b, c in _ATTRIBUTE.findall(rest)}
            out.keys += attributes
            out.values += attributes.values()
        out.attribute_starts.append(len(out.keys))
        parent = stack[-1] if stack else -1
        ordinal = counts[-1] if counts else 0
        if counts:
            counts[-1] += 1
        prefix, _, tag = name.rpartition(":")
        k = len(nodes) - base
        above, above_ns, grand, region, level, near = "", "", "", "", 0, _NOWHERE
        if stack:
            _, _, _, _, level, _, _, above, above_ns, grand, _, _, region, *_ = nodes[base + parent]
            region = above if above in REGIONS else region
            near = inner[-1]
        level = level if above == "sec" else 0
        if tag == "sec" and (above == "body" or level):
            level += 1
        nodes.append((k, parent, ordinal, len(stack), level, length, m.start(), tag, prefix, above, above_ns, grand, region, *near, held))
        out.children.append([])
        out.loose.append(False)
        if stack:
            out.children[base + parent].append(name)
        for column, value in ((ends, k), (until, length), (closing, m.end()), (closed, m.end()), (tailed, m.end()), (texts, ""), (tails, ""), (contents, None), (inners, None)):
            column.append(value)
        if empty:
            last = k
            continue
        after = xml.find("<", at)
        if after >= 0 and stack and xml.startswith(f"</{name}>", after):  # most elements hold nothing but text
            if after > at:
                text = decoded(at, after)
                raw = text.encode("utf-8", "replace")
                content.append(raw)
                length += len(raw)
                texts[base + k], out.loose[base + k], until[base + k] = text, not text.isspace(), length
            at = after + len(name) + 3
            closing[base + k], closed[base + k], tailed[base + k] = after, at, at
            last = k
        else:
            stack.append(k)
            names.append(name)
            counts.append(0)
            inner.append((*near[: _PLACE[tag]], k, *near[_PLACE[tag] + 1 :]) if tag in _PLACE else near)
            if held < 0 and tag in HOLDERS:
                held, piece = k, len(content)
            last = -1
    if stack:
        fail(f"{names[-1]} is not closed", len(xml))
    while stack:
        close(len(xml), len(xml))
    if len(nodes) == base:
        fail("no element", 0)
    else:
        contents[base] = b"".join(content)
    return error[0] if error else None
