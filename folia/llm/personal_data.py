"""Operator 7: personal data by fixed formats and bootstrapped contextual extraction.

Fixed formats find emails, addresses, cards and phones; these are the seeds. Every seed, and every other
token that looks like an identifier (6 or more of ``[A-Za-z0-9_-]``, 3 or more of them digits), stands in
lexical patterns of several granularities (``patterns_of``): two words before it, one word and
punctuation before it, one word before it with the token's shape, the words on both sides. Punctuation next to the token is
part of all of them. A token without a word before it is in no pattern.

Spark scores the graph of patterns and instances in rounds, until no score moves by more than ``SETTLED``: a pattern's confidence is the sum of its
distinct instances' scores over their number, damped by one; an instance's score is that of its best
pattern (the granularities share their evidence, so it is not added up). Seeds keep score 1, and opaque
tokens (keys, hashes: letters and digits mixed at random) keep at least ``OPAQUE``. What else follows a
pattern's context counts against it: the distinct ordinary words there are instances of score 0. They can only
lower a confidence, so another pass over the texts counts them for the patterns that are trusted without them, each up
to what its confidence can bear; a context with more is out of the graph. A share of the texts is read before, and what it breaks is not looked for in the rest.
Patterns with enough confidence and instances then mark the identifiers in them as ``id``, values
never seen as seeds included. A hash that is no secret looks like a key and is marked alike.

The graph holds one row per distinct pattern and instance, and only keys, patterns, places and digests of words
are shuffled, never texts. The contexts of the patterns to count are a stated set and go to the tasks in blocks of ``BLOCK``.

Defined results: null text has no spans; repeated rows are scanned on their own; a token with one word
before it has no pattern of two, however far its words are; ``MIN_CHARS`` and ``MIN_DIGITS`` say what looks like an identifier; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from itertools import islice

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm.common import cut, map_slices, row_key, table, written

KINDS = ("email", "ip", "card", "phone", "id")
SETTLED = 1e-3
MIN_CHARS, MIN_DIGITS = 6, 3
BLOCK = 100_000
SHARE = 64  # one text in so many is read first, to break contexts early
CONFIDENCE = 0.75
INSTANCES = 3
OPAQUE = 0.9  # least score of an opaque token: five distinct ones make a pattern
NEAR = 200  # code points around a span that mostly hold its words; else all words of the text are listed once

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_DOTTED = re.compile(r"[0-9][0-9.]+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_WORD = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"\w+")
_SPACE = re.compile(r"\s+")
_SWAP = re.compile(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")
_RUNS = re.compile(r"([a9])\1+")


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ takes the local part up to it (no further back than the last match) and the domain after it."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def addresses(text: str) -> list[tuple[int, int]]:
    runs = (m for m in _DOTTED.finditer(text) if m.group().count(".") >= 3)
    return [(r.start() + m.start(), r.start() + m.end()) for r in runs for m in _IP.finditer(r.group()) if all(map(_small, m.group().split(".")))]


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := "".join(_DIGITS.findall(m.group()))) <= 19 and _luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m.group())) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The seeds, by kind, then start."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *s) for s in addresses(text)]
        out += [("card", *s) for s in cards(text)]
        out += [("phone", *s) for s in phones(text)] if "+" in text else []
    return out


def identifiers(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Other tokens that look like identifiers and touch no seed."""
    out, last = [], 0
    used = sorted((a, b) for _, a, b in taken)
    k = 0
    for m in _DIGITS.finditer(text):
        if m.start() < last:
            continue
        start, end = m.span()
        while start > last and text[start - 1] in _TOKEN:
            start -= 1
        while end < len(text) and text[end] in _TOKEN:
            end += 1
        last = end
        while k < len(used) and used[k][1] <= start:
            k += 1
        free = k == len(used) or used[k][0] >= end
        if free and end - start >= MIN_CHARS and sum(map(str.isdigit, text[start:end])) >= MIN_DIGITS:
            out.append((start, end))
    return out


def opaque(token: str) -> bool:
    """Letters and digits mixed at random, as in a key: 16 or more characters that change sides 5 times or more."""
    return len(token) >= 16 and "@" not in token and len(_SWAP.findall(token)) >= 5


def shape_of(token: str) -> str:
    if opaque(token):
        return "*"
    return _RUNS.sub(r"\1", re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]", "a", token)))


def _side(gap: str) -> str:
    return re.sub(r"[0-9]+", "9", _SPACE.sub("", gap))


class Sides:
    """The words on both sides of places of a text: (word, start, end), as they are written."""

    def __init__(self, text: str):
        self.text, self.words = text, None

    def _all(self) -> list[tuple[int, int]]:
        if self.words is None:
            self.words = [m.span() for m in _WORD.finditer(self.text)]
        return self.words

    def left(self, at: int) -> list[tuple[int, int]]:
        """The last two words before a place, or as many as there are."""
        low = max(0, at - NEAR)
        near = [(low + m.start(), low + m.end()) for m in _WORD.finditer(self.text[low:at])][-2:]
        if low == 0 or len(near) == 2 and near[0][0] > low:
            return near
        words = self._all()
        k = bisect.bisect_left(words, (at, 0))
        near = words[max(0, k - 2) : k]
        return near[:-1] + [(near[-1][0], min(near[-1][1], at))] if near else near  # a span can begin inside a word

    def right(self, at: int) -> tuple[int, int] | None:
        """The first word after a place, or what is left of the one it lies in."""
        m = _WORD.search(self.text, at, at + NEAR)
        if m and m.end() < at + NEAR:
            return m.span()
        words = self._all()
        k = bisect.bisect_left(words, (at, 0))
        if k and words[k - 1][1] > at:
            return at, words[k - 1][1]
        return words[k] if k < len(words) else None


def contexts_of(sides: Sides, start: int, end: int) -> list[str]:
    """What surrounds a token, finest last: its left word, its two left words, its words on both sides; none without a left word."""
    text, words = sides.text, sides.left(start)
    if not words:
        return []
    word = lambda span: text[span[0] : span[1]].lower()
    one = f"{word(words[-1])} {_side(text[words[-1][1] : start])}"
    out = [f"1 {one}"]
    if len(words) == 2:
        out.append(f"2 {word(words[0])} {_side(text[words[0][1] : words[1][0]])} {one}")
    if right := sides.right(end):
        out.append(f"3 {one} _ {_side(text[end : right[0]])} {word(right)}")
    return out


def patterns_of(sides: Sides, start: int, end: int) -> list[tuple[str, str]]:
    """(pattern, context) of a token: each context, but the left word alone needs punctuation or the token's shape."""
    out = []
    for context in contexts_of(sides, start, end):
        if context[0] != "1" or context[-1] != " ":
            out.append((context, context))
        if context[0] == "1":
            out.append((f"{context} {shape_of(sides.text[start:end])}", context))
    return out


class Known:
    """Contexts with the number of ordinary words that each can have, by their left word. A context that has more in what a task reads is broken and is not looked for any more."""

    def __init__(self, most: dict[str, int]):
        self.most, self.seen = dict(most), {}
        self.by_word: dict[str, tuple[set, Counter, Counter]] = {}
        for context in most:
            word, two, three = self._keys(context)
            ones, twos, threes = self.by_word.setdefault(word, (set(), Counter(), Counter()))
            if two is not None:
                twos[two] += 1
            elif three is not None:
                threes[three] += 1
            else:
                ones.add(context)

    @staticmethod
    def _keys(context: str) -> tuple[str, str | None, str | None]:
        """The left word, and the second left word or the right word that a context asks for."""
        parts = context.split(" ")
        if parts[0] == "2":
            return parts[3], parts[1], None
        return parts[1], None, parts[-1] if parts[0] == "3" else None

    def add(self, context: str, digest: str) -> tuple[str, str | None] | None:
        """The row that a word after a context gives: the pair, where it is new, or the broken context with null."""
        words = self.seen.setdefault(context, set())
        if digest in words:
            return None
        words.add(digest)
        if len(words) <= self.most[context]:
            return context, digest
        del self.seen[context], self.most[context]
        word, two, three = self._keys(context)
        ones, twos, threes = self.by_word[word]
        for keys, key in ((twos, two), (threes, three)):
            if key is not None:
                keys[key] -= 1
                if not keys[key]:
                    del keys[key]
        ones.discard(context)
        if not (ones or twos or threes):
            del self.by_word[word]
        return context, None


def ordinary(texts: list[str], known: Known) -> list[tuple[str, str | None]]:
    """Rows of ``Known.add`` for the words that follow a known context and are neither seeds nor identifiers."""
    out: list[tuple[str, str | None]] = []
    done: set[tuple[str, str, str]] = set()  # (left word, gap, word) whose left word alone is dealt with
    get = known.by_word.get
    for text in texts:
        spans, sides = None, Sides(text)
        last = before = ""
        at = 0  # end of the last word
        for m in _RUN.finditer(text):
            (start, end), run = m.span(), m.group().lower()
            here, second, gap_at = last, before, at
            if run.isalpha():
                before, last, at = last, run, end
            else:
                for word in _WORD.finditer(text, start, end):
                    before, last, at = last, word.group().lower(), word.end()
            if (want := get(here)) is None:
                continue
            ones, twos, threes = want
            key = (here, text[gap_at:start], run)
            new = bool(ones) and key not in done
            more = second in twos or threes and (right := _WORD.search(text, end)) and right.group().lower() in threes
            if not (new or more):
                continue
            if spans is None:
                seeds = base_spans(text)
                spans = sorted([(a, b) for _, a, b in seeds] + identifiers(text, seeds))
            k = bisect.bisect_left(spans, (end, 0))
            if any(b > start for _, b in spans[max(0, k - 3) : k]):
                continue
            both = {c for c in contexts_of(sides, start, end) if c in known.most} if more else set()
            if new:
                done.add(key)
                both |= ones & {f"1 {here} {_side(key[1])}"}
            if both:
                digest = xxhash.xxh64_hexdigest(run)
                out += [row for c in both if (row := known.add(c, digest))]
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(batch: pa.RecordBatch, least: float) -> dict:
    out: dict[str, list] = {"n": [], "base": [], "sha": [], "found": []}
    for text in batch.column("text").to_pylist():
        text = text or ""
        seeds = base_spans(text)
        base = _joined(seeds)
        out["n"].append([sum(k == kind for k, _, _ in seeds) for kind in KINDS[:4]])
        out["base"].append(base)
        out["sha"].append(hashlib.sha256(base.encode()).hexdigest())
        sides = Sides(text)
        spans = [(True, a, b) for _, a, b in seeds] + [(False, a, b) for a, b in (identifiers(text, seeds) if _DIGIT.search(text) else [])]
        out["found"].append(
            [
                {"pattern": p, "context": c, "instance": xxhash.xxh64_hexdigest(text[a:b].lower()), "start": a, "end": b, "seed": s,
                    "prior": 1.0 if s else least * opaque(text[a:b])}
                for s, a, b in spans
                for p, c in patterns_of(sides, a, b)
            ]
        )
    return {"doc_id": batch.column("doc_id"), "key": batch.column("key")} | out


def scan(docs: DataFrame, least: float = OPAQUE) -> DataFrame:
    """doc_id, key, n (count of each base kind), base, sha, found (pattern, context, instance, start, end, seed, prior) per row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", row_key("text").alias("key"), "text")
    found = "array<struct<pattern:string,context:string,instance:string,start:bigint,end:bigint,seed:boolean,prior:double>>"
    return map_slices(rows, "text", lambda batch: _scan(batch, least), f"doc_id {kind}, key long, n array<bigint>, base string, sha string, found {found}")


def pattern_scores(edges: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Of distinct edges (pattern, context, instance, prior), and others (context, others: number of ordinary words): pattern, context, confidence, instances.

    Scores only rise and end at 1, and a round in which none rises by more than ``SETTLED`` is the last, so the rounds come to an end.
    Sums are combined before the shuffle; an edge meets its pattern's row by a join whose skewed partitions adaptive execution splits.
    """
    scores = edges.groupBy("instance").agg(F.max("prior").alias("score"))
    while True:
        patterns = edges.join(scores, "instance").groupBy("pattern", "context").agg(F.sum("score").alias("total"), F.count("*").alias("instances"))
        patterns = patterns.withColumn("others", F.lit(0)) if others is None else patterns.join(others, "context", "left").fillna(0, ["others"])
        patterns = cut(patterns.select("pattern", "context", "instances", (F.col("total") / (F.col("instances") + F.col("others") + 1)).alias("confidence")))
        reached = edges.join(patterns.drop("context", "instances"), "pattern").groupBy("instance").agg(F.greatest(F.max("prior"), F.max("confidence")).alias("next"))
        both = cut(reached.join(scores, "instance").select("instance", F.col("next").alias("score"), F.abs(F.col("next") - F.col("score")).alias("moved")))
        scores = both.drop("moved")
        if both.where(F.col("moved") > SETTLED).isEmpty():
            return patterns


def other_words(docs: DataFrame, contexts: DataFrame, block: int = BLOCK) -> DataFrame:
    """context, others, broken of contexts (context, most): how many distinct ordinary words follow each, and whether they are over ``most``.

    A task stops counting a context when what it has read breaks it, so others is exact where broken is false. Texts are read
    once per block of contexts.
    """

    def scanned(most: dict[str, int]) -> DataFrame:
        known = Known(most)

        def count(batch: pa.RecordBatch) -> dict:
            rows = ordinary([text or "" for text in batch.column("text").to_pylist()], known) if known.by_word else ()
            return {"context": [c for c, _ in rows], "word": [w for _, w in rows]}

        rows = map_slices(docs.select("text"), "text", count, "context string, word string").distinct()
        return rows.groupBy("context").agg(F.count("word").alias("others"), F.bool_or(F.col("word").isNull()).alias("over"))

    rows = ((row["context"], row["most"]) for row in contexts.select("context", "most").toLocalIterator())
    out = None
    while (part := dict(islice(rows, block))) or out is None:
        counted = scanned(part)
        out = counted if out is None else out.unionByName(counted)
        if len(part) == block:
            out = written(out)  # the driver holds one block at a time
    return out.join(contexts.select("context", "most"), "context").select("context", "others", (F.col("over") | (F.col("others") > F.col("most"))).alias("broken"))


def trusted_patterns(docs: DataFrame, found: DataFrame, confidence: float = CONFIDENCE, instances: int = INSTANCES) -> DataFrame:
    """Patterns with enough confidence and instances. A context with more ordinary words than any of its patterns can bear leaves the graph before the last scoring."""
    enough = (F.col("confidence") >= confidence) & (F.col("instances") >= instances)
    edges = cut(found.groupBy("pattern", "context", "instance").agg(F.max("prior").alias("prior")))
    possible = written(pattern_scores(edges).where(enough).select("pattern", "context", "instances"))
    # Confidence is at most instances / (instances + others + 1).
    most = F.greatest(F.lit(0), F.floor(F.max("instances") * (1 / confidence - 1) - 1 + 1e-9)).cast("long")
    asked = written(possible.groupBy("context").agg(most.alias("most")))
    # A sixty-fourth of the texts already breaks most contexts; what is left is counted in all of them.
    first = written(other_words(docs.where(F.pmod(F.xxhash64("text"), F.lit(SHARE)) == 0), asked).where("broken"))
    others = written(other_words(docs, asked.join(first, "context", "left_anti")).unionByName(first))
    left = possible.join(others.where("broken"), "context", "left_anti").select("pattern")
    return written(pattern_scores(cut(edges.join(left, "pattern")), others.select("context", "others")).where(enough).select("pattern"))


def personal_data(docs: DataFrame, confidence: float = CONFIDENCE, instances: int = INSTANCES, least: float = OPAQUE) -> DataFrame:
    """One row per row of docs (doc_id, text): counts of the fixed kinds, their digest, and all spans. least: the score that opaque tokens have at least."""
    rows = cut(scan(docs, least))
    found = rows.select("doc_id", "key", F.inline("found"))
    trusted = trusted_patterns(docs, found, confidence, instances)
    more = found.where("not seed").join(trusted, "pattern").select("doc_id", "key", "start", "end").distinct()
    more = more.groupBy(F.col("doc_id").alias("id"), F.col("key").alias("its")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("more"))
    both = rows.join(more, F.expr("doc_id <=> id and key = its"), "left")
    extra = F.array_join(F.transform("more", lambda s: F.concat_ws(":", F.lit("id"), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return both.select(
        "doc_id", *[F.get("n", F.lit(k)).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])], F.col("sha").alias("base_sha256"),
        F.concat_ws(",", F.nullif("base", F.lit("")), extra).alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
