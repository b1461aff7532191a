"""The article grammar as tables: a finite automaton per element, and typed attribute declarations, for every version.

``standard`` states the content models. Each becomes a minimal automaton here: rows (element, state, tag, next), the states in
which the element may end, and what it expects in each state. For running them over the children of many elements at once, tags that
an element treats alike share a symbol, so that a step is an array access. All tables are fixed and small; they are broadcast.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import count
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from folia.sources import standard as S

VERSIONS = ("1.3", "1.4")
TYPES = ("CDATA", "ID", "IDREF", "IDREFS", "NMTOKEN", "NMTOKENS")


class Automaton(NamedTuple):
    mixed: bool
    steps: list[dict[str, int]]  # next state by tag, per state; 0 is the first
    ends: list[bool]  # whether the element may end there


class Attribute(NamedTuple):
    element: str
    name: str
    kind: str  # one of TYPES or "enumeration"
    required: bool
    allowed: list[str] | None


def entries(text: str) -> list[tuple[str, str]]:
    """(head, rest) of the lines of a statement; lines that begin with a space go on."""
    lines = re.sub(r"\n +", " ", text).strip("\n").split("\n")
    return [re.match(r"(.*?):(?: (.*)|$)", line).groups(default="") for line in lines]


def _expanded(names: str, classes: dict[str, list[str]]) -> list[str]:
    return [t for n in names.split() for t in (classes[n[1:]] if n[0] == "@" else [n])]


def _classes(text: str) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for name, members in entries(text):
        out[name] = _expanded(members, out)
    return out


def _positions(model: str, classes: dict[str, list[str]]):
    """Labels of the model's positions, their followers, the first ones, the last ones, and whether it may be empty."""
    tokens = re.findall(r"[^\s()|?*+]+|[()|?*+]", model)
    labels: list[str] = []
    follow: list[set[int]] = []
    at = 0

    def leaf(tag: str):
        if tag == "#":
            return set(), set(), True
        labels.append(tag)
        follow.append(set())
        return {len(labels) - 1}, {len(labels) - 1}, False

    def item():
        nonlocal at
        token = tokens[at]
        at += 1
        if token == "(":
            out = choice()
            at += 1  # the closing one
        else:
            parts = [leaf(t) for t in (classes[token[1:]] if token[0] == "@" else [token])]
            out = set().union(*(p[0] for p in parts)), set().union(*(p[1] for p in parts)), any(p[2] for p in parts)
        if at < len(tokens) and tokens[at] in "?*+":
            first, last, empty = out
            if tokens[at] in "*+":
                for p in last:
                    follow[p] |= first
            out = first, last, empty or tokens[at] in "?*"
            at += 1
        return out

    def sequence():
        first, last, empty = set(), set(), True
        while at < len(tokens) and tokens[at] not in "|)":
            f, l, e = item()
            for p in last:
                follow[p] |= f
            first, last, empty = first | f if empty else first, last | l if e else l, empty and e
        return first, last, empty

    def choice():
        nonlocal at
        parts = [sequence()]
        while at < len(tokens) and tokens[at] == "|":
            at += 1
            parts.append(sequence())
        return set().union(*(p[0] for p in parts)), set().union(*(p[1] for p in parts)), any(p[2] for p in parts)

    first, last, empty = choice()
    return labels, follow, first, last, empty


def automaton(model: str, classes: dict[str, list[str]]) -> Automaton:
    """The minimal deterministic automaton of a content model."""
    labels, follow, first, last, empty = _positions(model, classes)
    numbers: dict[frozenset, int] = {frozenset({-1}): 0}
    steps, ends, todo = [], [], [frozenset({-1})]
    while todo:
        state = todo.pop(0)
        by_tag: dict[str, set[int]] = {}
        for p in state:
            for q in first if p < 0 else follow[p]:
                by_tag.setdefault(labels[q], set()).add(q)
        step = {}
        for tag, reached in by_tag.items():
            key = frozenset(reached)
            if key not in numbers:
                numbers[key] = len(numbers)
                todo.append(key)
            step[tag] = numbers[key]
        steps.append(step)
        ends.append(any(p in last for p in state) or (empty and -1 in state))
    # States that end alike and step alike are one.
    block = [int(e) for e in ends]
    while True:
        rows = [(ends[s], tuple(sorted((t, block[n]) for t, n in steps[s].items()))) for s in range(len(steps))]
        index: dict = {}
        after = [index.setdefault(r, len(index)) for r in rows]
        if after == block:
            break
        block = after
    kept = [block.index(b) for b in range(max(block) + 1)]
    return Automaton("#" in model, [{t: block[n] for t, n in steps[s].items()} for s in kept], [ends[s] for s in kept])


@lru_cache(maxsize=1)
def models() -> dict[str, str]:
    """Content model of every element, MathML's with their prefix."""
    out = {e: model for names, model in entries(S.MODELS) for e in names.split()}
    own = _classes(S.MATH_CLASSES)
    math = {e for names, _ in entries(S.MATH_MODELS) for e in _expanded(names, own)}

    def prefixed(m: re.Match) -> str:
        return m[0] if m[0] == "#" else m[0][5:] if m[0].startswith("jats:") else f"@mml:{m[0][1:]}" if m[0][0] == "@" else f"mml:{m[0]}"

    for names, model in entries(S.MATH_MODELS):
        for e in _expanded(names, own):
            out[f"mml:{e}"] = re.sub(r"[^\s()|?*+]+", prefixed, model)
    assert {f"mml:{e}" for e in math} <= set(out)
    return out


@lru_cache(maxsize=1)
def automata() -> dict[str, Automaton]:
    classes = _classes(S.CLASSES) | {f"mml:{k}": [f"mml:{x}" for x in v] for k, v in _classes(S.MATH_CLASSES).items()}
    built: dict[str, Automaton] = {}
    for m in models().values():
        if m not in built:
            built[m] = automaton(m, classes)
    return {e: built[m] for e, m in models().items()}


def _attributes(text: str, names: list[str], classes: dict[str, list[str]], prefix: str = "") -> list[Attribute]:
    out: dict[tuple[str, str], Attribute] = {}
    for head, where in entries(text):
        *attributes, kind = head.split()
        elements = _expanded(where, classes)
        if elements[:2] == ["all", "but"]:
            elements = [n for n in names if n not in elements[2:]]
        elif elements == ["all"]:
            elements = names
        allowed = None if kind in TYPES else [kind[1:-1]] if kind[0] == "'" else kind.split("|")
        for e in elements:
            for a in attributes:
                declared = Attribute(prefix + e, a.rstrip("!"), kind if kind in TYPES else "enumeration", a.endswith("!"), allowed)
                # Attributes that differ in their prefix alone are one here; it takes what either takes.
                if (before := out.get((e, declared.name))) and before.kind != declared.kind:
                    declared = declared._replace(kind="CDATA", allowed=None)
                out[e, declared.name] = declared
    return list(out.values())


@lru_cache(maxsize=4)
def attributes(version: str = "1.4") -> list[Attribute]:
    names = list(models())
    own = [n for n in names if not n.startswith("mml:")]
    declared = _attributes(S.ATTRIBUTES, own, _classes(S.CLASSES)) + _attributes(S.MATH_ATTRIBUTES, [n[4:] for n in names if n.startswith("mml:")], {}, "mml:")
    more: dict[tuple[str, str], list[str]] = {}
    for v in VERSIONS[: VERSIONS.index(version) + 1]:
        for key, values in S.VERSION_VALUES.get(v, {}).items():
            more.setdefault(key, []).extend(values.split())
    return [d._replace(allowed=d.allowed + more[d.element, d.name]) if (d.element, d.name) in more else d for d in declared]


def _table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows)) if rows else [()] * len(target)
    return spark.createDataFrame(pa.table([pa.array(list(c), f.type) for c, f in zip(columns, target)], schema=target), schema)


def content_model(spark: SparkSession, version: str = "1.4") -> DataFrame:
    """version, element, model, mixed, states: every element that the version declares."""
    return _table(spark, "version string, element string, model string, mixed boolean, states int",
        [(version, e, m, automata()[e].mixed, len(automata()[e].steps)) for e, m in models().items()])


def transitions(spark: SparkSession, version: str = "1.4") -> DataFrame:
    """version, element, state, tag, next, ends: the automata as rows; a state without a step has one row without tag."""
    rows = []
    for e, a in automata().items():
        for s, step in enumerate(a.steps):
            rows += [(version, e, s, t, n, a.ends[s]) for t, n in step.items()] or [(version, e, s, None, None, a.ends[s])]
    return _table(spark, "version string, element string, state int, tag string, next int, ends boolean", rows)


def attr_decl(spark: SparkSession, version: str = "1.4") -> DataFrame:
    """version, element, attribute, type, required, allowed (the values of an enumeration)."""
    return _table(spark, "version string, element string, attribute string, type string, required boolean, allowed array<string>",
        [(version, d.element, d.name, d.kind, d.required, d.allowed) for d in attributes(version)])


@lru_cache(maxsize=1)
def _symbols() -> tuple[dict[tuple[str, str], int], dict[str, tuple]]:
    """Symbol of (element, child's tag), and per element (width, next state by state and symbol, ends, expected tags by state)."""
    symbols, tables = {}, {}
    for e, a in automata().items():
        columns: dict = {}
        number = count()
        for tag in dict.fromkeys(t for step in a.steps for t in step):
            column = tuple(step.get(tag, -1) for step in a.steps)
            if column not in columns:
                columns[column] = next(number)
            symbols[e, tag] = columns[column]
        width = len(columns)
        moves = [column[s] for s in range(len(a.steps)) for column in columns]
        expected = [" | ".join([*step, *["nothing more"] * a.ends[s]]) or "nothing" for s, step in enumerate(a.steps)]
        tables[e] = (width, moves, a.ends, expected)
    return symbols, tables


def automaton_table(spark: SparkSession) -> DataFrame:
    """element, mixed, tags, symbols, width, moves, ends, expected: the automata for running.

    symbols[k] is what tags[k] counts as; moves[state * width + symbol] is the next state or -1. A tag that is not there fits nowhere.
    """
    symbols, tables = _symbols()
    tags: dict[str, list[str]] = {e: [] for e in tables}
    for e, t in symbols:
        tags[e].append(t)
    return _table(spark, "element string, mixed boolean, tags array<string>, symbols array<int>, width int, moves array<int>, ends array<boolean>, expected array<string>",
        [(e, automata()[e].mixed, tags[e], [symbols[e, t] for t in tags[e]], *t_) for e, t_ in tables.items()])
