"""Operator 9: main text of web pages by a tree-structured graphical model.

A page becomes a tree: block elements are inner nodes, runs of text between block boundaries are leaves.
Every node is content or not. Its potential comes from what it looks like (an element's tag and each word
of its class, id and role; a leaf's length and share of linked text), and an edge's potential from how often a
child is content given its parent, for containers and for text elements apart: text rarely differs from
what holds it. Sum-product messages pass from the leaves to the root and back, which
gives each leaf's exact marginal; leaves above one half are the text. Pages of a slice are solved together,
depth by depth.

Navigation, asides, headers, footers, forms and dialogs are never content; lists, tables and their cells have no potential of their own
and follow what they stand in.

Potentials are trained on pages whose markup labels them: what lies in ``article`` or ``main`` is content
unless ``nav``, ``aside``, ``footer``, ``form`` or a class that names boilerplate stands between. The
sample is bounded: pages are taken by a hash of their id, ``TRAIN_PAGES`` in the mean. Counts are scaled
to ``WEIGHT`` nodes and start from a fixed prior, so elements that no labelled page has are known too; names that the
labelled pages use are learned, whatever they are. Spark sums the counts; what reaches the driver has a row per feature
value of the sample.

A page is read in one forward scan. A ``<`` that opens neither a comment nor a tag that closes before the next ``<`` is text. Scripts, styles and form
fields are skipped; any other element that is no block (math, object, noscript ...) is markup around its text.

Defined results: null html, or a page without content, gives an empty text; markup that never closes runs
to the end of the page; a quote that never closes counts as a character; repeated pages are each extracted; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm.common import map_slices, table

TRAIN_PAGES = 2000
WEIGHT = 200.0

#: Element names of HTML.
BLOCKS = frozenset("html head body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption nav header footer aside form fieldset address details summary dialog hgroup menu title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea select button option".split())
CLOSES_P = BLOCKS - {"html", "head", "body"}
#: Words in class and id that name boilerplate, or content.
AGAINST = frozenset("ad ads advert advertisement adverts sponsor sponsored promo banner cookie cookies consent notice alert nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer header masthead comment comments reply replies respond discussion disqus share sharing social related recommended newsletter subscribe signup login search popup modal widget toolbar pagination copyright legal".split())
FOR = frozenset("article content main post entry story body text page".split())

#: Elements that an article's text never lies in, whatever is in them; a header's headings count as its parent's.
CLOSED = frozenset("nav aside footer header form fieldset dialog menu head title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER = -40.0  # log potential of content for them
#: Lists and tables stand in menus as in articles, and their items are many: where they stand decides, not what they look like.
PLACED = frozenset("ul ol li dl dt dd table thead tbody tfoot tr td th caption figcaption".split())
#: Text elements and leaves of one article tell the same thing again and again: their own potentials count by this share.
TEMPER = 0.35

#: Prior counts of (other, content) nodes.
PRIOR_TAG = {"nav": (40, 0.2), "aside": (40, 0.2), "footer": (40, 0.2), "header": (20, 0.5), "form": (40, 0.2), "head": (40, 0.2), "title": (40, 0.2),
    "menu": (40, 0.2), "dialog": (40, 0.2), "fieldset": (40, 0.2), "address": (5, 1), "article": (0.5, 20), "main": (1, 20), "p": (20, 20),
    "h1": (4, 6), "h2": (6, 6), "h3": (6, 6), "h4": (6, 6), "h5": (6, 6), "h6": (6, 6), "blockquote": (1, 6), "pre": (1, 6), "figcaption": (1, 4),
    "ul": (10, 5), "ol": (5, 5), "li": (20, 10), "div": (20, 10), "section": (10, 10), "html": (20, 0.2), "body": (10, 2)}
PRIOR_WORD = {"against": (6, 0.002), "for": (0.02, 2), "other": (1, 1)}
PRIOR_LINKS = {"all": (20, 1), "some": (5, 5), "none": (10, 20)}
#: By kind of child: (parent's label, child's label).
PRIOR_EDGE = {"container": {(0, 0): 60, (0, 1): 8, (1, 0): 6, (1, 1): 30}, "text": {(0, 0): 60, (0, 1): 0.3, (1, 0): 1, (1, 1): 60}}
TEXT = frozenset("# p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figcaption title summary address".split())

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"""(?:[^"'<>]++|"[^"]*+"|'[^']*+')*+""")
_PLAIN = re.compile(r"[^<>]*+")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[a-z]+")
_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}


def _words(attributes: str) -> str:
    """The distinct words of the class, id and role."""
    if not attributes or "=" not in attributes:
        return ""
    return " ".join(sorted({w for m in _NAMES.finditer(attributes) for w in _PARTS.findall((m[1] or m[2] or m[3] or "").lower())}))


def _side(word: str) -> str:
    return "against" if word in AGAINST else "for" if word in FOR else "other"


def _length(n: int) -> str:
    return "1" if n < 25 else "2" if n < 80 else "3" if n < 250 else "4"


def parse(html: str) -> list[tuple[int, str, str, str]]:
    """Nodes in page order: (parent, kind, feature, text). Inner: kind is the tag, feature what its names say. Leaf: kind '#', feature links and length."""
    nodes: list[tuple[int, str, str, str]] = [(-1, "html", "", "")]
    stack = [(0, "html")]
    run: list[str] = []
    linked = links = 0  # characters inside links, depth of open links

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(unescape("".join(run)).split())
            if text:
                share = linked / max(1, sum(map(len, run)))
                nodes.append((stack[-1][0], "#", ("all" if share > 0.5 else "some" if share > 0 else "none") + _length(len(text)), text))
            run.clear()
        linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        run.append(piece)
        linked += len(piece.strip()) if links else 0

    at, size, quotes = 0, len(html), True
    while at < size:
        start = html.find("<", at)
        if start < 0:
            start = size
        if start > at:
            text(html[at:start])
        if start == size:
            break
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = end + 3 if end >= 0 else size
            continue
        if html.startswith("<![CDATA[", start):
            end = html.find("]]>", start)
            text(html[start + 9 : end if end >= 0 else size])
            at = end + 3 if end >= 0 else size
            continue
        if html.startswith(("<!", "<?"), start):
            end = html.find(">", start)
            at = end + 1 if end >= 0 else size
            continue
        m = _NAME.match(html, start + 1)
        if not m:
            text("<")
            at = start + 1
            continue
        end = (_QUOTED if quotes else _PLAIN).match(html, m.end()).end()
        if end < size and html[end] not in "<>":
            quotes = False  # this quote never closes: from here on quotes are characters
            end = _PLAIN.match(html, m.end()).end()
        if end == size:
            break
        if html[end] == "<":  # no tag
            text("<")
            at = start + 1
            continue
        at = end + 1
        closing, name, attributes = m[1], m[2].lower(), html[m.end() : end]
        if name == "a":
            links = 0 if closing else 1
        elif name in VOID:
            run.append(" ")
            if name == "hr":
                flush()
        elif name in RAW:
            if not closing and not attributes.endswith("/"):
                end = _END[name].search(html, at)
                at = end.end() if end else size
            run.append(" ")
        elif name in BLOCKS:
            flush()
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][1] == name:
                        del stack[k:]
                        break
            else:
                if name in CLOSES_P and stack[-1][1] == "p" or name in ("li", "dt", "dd", "tr", "td", "th") and stack[-1][1] == name:
                    stack.pop()
                if name != "html":
                    at_level = -2 if name in HEADINGS and stack[-1][1] == "header" else -1
                    nodes.append((stack[at_level][0], name, _words(attributes), ""))
                    stack.append((len(nodes) - 1, name))
    flush()
    return nodes


def labels(nodes: list[tuple[int, str, str, str]]) -> list[int] | None:
    """What the markup says of each node; None if the page has neither article nor main."""
    if not any(kind in ("article", "main") for _, kind, _, _ in nodes):
        return None
    out: list[int] = []
    for parent, kind, feature, _ in nodes:
        if kind in CLOSED or kind != "#" and any(w in AGAINST for w in feature.split(" ")):
            out.append(0)
        elif kind in ("article", "main"):
            out.append(1)
        else:
            out.append(out[parent] if parent >= 0 else 0)
    return out


def _count(batch: pa.RecordBatch) -> dict:
    counts: Counter = Counter()
    for html in batch.column("html").to_pylist():
        nodes = parse(html or "")
        y = labels(nodes)
        for (parent, kind, feature, _), label in zip(nodes, y or [], strict=False):
            if kind == "#":
                counts["links", feature[:-1], label] += 1
                counts["length", feature[-1], label] += 1
            else:
                counts["tag", kind, label] += 1
                counts["named", "", label] += bool(feature)
                for word in feature.split():
                    counts["word", word, label] += 1
            if parent >= 0:
                counts["edge", f"{'text' if kind in TEXT else 'container'} {y[parent]}", label] += 1
    rows = list(counts.items())
    return {"what": [k[0] for k, _ in rows], "value": [k[1] for k, _ in rows], "label": [k[2] for k, _ in rows], "n": [n for _, n in rows]}


class Model:
    """Log potentials: per feature value (other, content), and per (parent's label, child's label)."""

    def __init__(self, counts: dict[tuple[str, str, int], int]):
        self.node: dict[tuple[str, str], tuple[float, float]] = {}
        values = {"tag": (sorted(BLOCKS), PRIOR_TAG), "links": (list(PRIOR_LINKS), PRIOR_LINKS), "length": (list("1234"), {"1": (8, 4), "2": (6, 6), "3": (4, 8), "4": (2, 8)})}
        for what, (names, prior) in values.items():
            seen = np.array([[counts.get((what, v, y), 0) for y in (0, 1)] for v in names], float)
            table = seen * np.minimum(1, WEIGHT / np.maximum(seen.sum(axis=0), 1)) + [prior.get(v, (2, 2)) for v in names]
            logs = np.log(table / table.sum(axis=0))
            self.node |= {(what, v): tuple(x) for v, x in zip(names, logs.tolist(), strict=True)}
        # A word tells by its share of the named nodes of either label; one that no labelled page has, by the prior alone.
        named = [counts.get(("named", "", y), 0) for y in (0, 1)]
        scale = [min(1, WEIGHT / max(n, 1)) for n in named]
        for word in {v for what, v, _ in counts if what == "word"} | AGAINST | FOR:
            prior, seen = PRIOR_WORD[_side(word)], [scale[y] * counts.get(("word", word, y), 0) for y in (0, 1)]
            self.node["word", word] = tuple(math.log((seen[y] + prior[y]) / (scale[y] * named[y] * any(seen) + 10)) for y in (0, 1))
        seen = np.array([[[counts.get(("edge", f"{kind} {p}", c), 0) for c in (0, 1)] for p in (0, 1)] for kind in ("container", "text")], float)
        edge = seen * np.minimum(1, WEIGHT / np.maximum(seen.sum(axis=2, keepdims=True), 1))
        edge += [[[PRIOR_EDGE[kind][p, c] for c in (0, 1)] for p in (0, 1)] for kind in ("container", "text")]
        self.edge = np.log(edge / edge.sum(axis=2, keepdims=True))  # kind of child, parent's label, child's label

    def potential(self, kind: str, feature: str) -> tuple[float, float]:
        if kind == "#":
            a, b = self.node["links", feature[:-1]], self.node["length", feature[-1]]
            return TEMPER * (a[0] + b[0]), TEMPER * (a[1] + b[1])
        if kind in CLOSED:
            return 0.0, NEVER
        share = 0.0 if kind in PLACED else TEMPER if kind in TEXT else 1.0
        other, content = (share * x for x in self.node["tag", kind])
        for x in (self.node.get(("word", w)) for w in feature.split()):
            other, content = (other + x[0], content + x[1]) if x else (other, content)
        return other, content

    def marginals(self, parents: np.ndarray, potentials: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """P(content) of every node of a forest (kinds: 1 for text elements); parents come before their children, roots have parent -1."""
        n = len(parents)
        depth = np.zeros(n, np.int64)
        for k, p in enumerate(parents.tolist()):
            if p >= 0:
                depth[k] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        bounds = np.searchsorted(depth[order], np.arange(depth.max() + 2))
        levels = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        up = potentials.copy()  # own potential and all messages from below
        sent = np.zeros((n, 2))
        for level in reversed(levels[1:]):
            edge = self.edge[kinds[level]]
            sent[level] = np.logaddexp(up[level, 0, None] + edge[:, :, 0], up[level, 1, None] + edge[:, :, 1])
            np.add.at(up, parents[level], sent[level])
        down = np.zeros((n, 2))  # messages from above
        down[levels[0]] = np.log([0.95, 0.05])
        for level in levels[1:]:
            above = down[parents[level]] + up[parents[level]] - sent[level]
            edge = self.edge[kinds[level]]
            down[level] = np.logaddexp(above[:, 0, None] + edge[:, 0], above[:, 1, None] + edge[:, 1])
        both = up + down
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))


def texts_of_pages(pages: list[str], model: Model) -> list[str]:
    parents, potentials, kinds, texts, starts = [], [], [], [], []
    cache: dict[tuple[str, str], tuple[float, float]] = {}
    for html in pages:
        base = len(parents)
        starts.append(base)
        nodes = parse(html)
        for parent, kind, feature, text in nodes:
            parents.append(parent + base if parent >= 0 else -1)
            if (kind, feature) not in cache:
                cache[kind, feature] = model.potential(kind, feature)
            item = kind == "#" and nodes[parent][1] in PLACED
            potentials.append((0.0, 0.0) if item else cache[kind, feature])
            kinds.append(int(kind in TEXT))
            texts.append(text)
    if not parents:
        return []
    keep = model.marginals(np.array(parents, np.int64), np.array(potentials), np.array(kinds)) >= 0.5
    starts.append(len(parents))
    return ["\n\n".join(texts[k] for k in range(a, b) if texts[k] and keep[k]) for a, b in zip(starts, starts[1:], strict=False)]


def train(pages: DataFrame, sample: int = TRAIN_PAGES) -> Model:
    """Potentials from about ``sample`` pages, taken by a hash of page_id."""
    every = max(1, round(pages.count() / sample))
    taken = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0).select("html")
    counts = map_slices(taken, "html", _count, "what string, value string, label int, n long")
    rows = counts.groupBy("what", "value", "label").agg(F.sum("n").alias("n")).collect()
    return Model({(r["what"], r["value"], r["label"]): r["n"] for r in rows})


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html)."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def make(batch: pa.RecordBatch) -> dict:
        found = texts_of_pages([h or "" for h in batch.column("html").to_pylist()], model)
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": found, "n_chars": [len(t) for t in found]}

    return map_slices(pages.select("page_id", "url", "html"), "html", make, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages))
