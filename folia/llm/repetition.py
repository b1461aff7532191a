"""Operator 4: quality rules from suffix-array repetition.

The words of a slice of documents are one sequence; a suffix never runs past its document. Suffixes are
ordered by prefix doubling (3, 6, 12, ... words): a rank is a class of equal prefixes, and only suffixes
that still share their class are looked at again. Neighbours in the finished order give the longest
common prefixes; their maxima are the maximal repeated substrings, whose spans are united per document.
A document fails if the covered share of its words, or its longest repeat relative to its length, is
over the limit. Repeats shorter than ``min_repeat`` words do not count for the verdict.

Everything is linear in a slice but the sorting; a document longer than a slice is handled alone.

Defined results: null text has no words and fails (under 50 words); repeated rows are judged alike;
the input's other columns are not touched by ``quality_stage`` and ignored by ``repetition``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm.common import map_slices, numbered, table, texts_of

WINDOW = 3
MIN_WORDS = 50
MIN_REPEAT = 8
MAX_COVERED = 0.3
MAX_LONGEST = 0.25

_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_BLANK = re.compile(rb"[\x20\x09-\x0d]*")
_NOT_SYMBOLS = bytes(set(range(256)) - set(b"#*$%&|<>"))
_CONTINUATION = bytes(range(0x80, 0xC0))


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts as dense integers, and the number of words of each text."""
    split = [t.split() for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    return numbered([w for words in split for w in words])[0], counts


def _classes(*keys: np.ndarray) -> np.ndarray:
    """For each position, where its class starts in the order of the keys (the first key counts most)."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    out = np.empty(len(order), np.int64)
    out[order] = first
    return out


def longest_repeats(words: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each position, the length of the longest prefix of its suffix that the document has elsewhere too; 0 below window."""
    n = len(words)
    out = np.zeros(n, np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    end = np.repeat(np.cumsum(counts), counts)
    if not n:
        return out
    # Words past a document's end count as -1, below all words: short suffixes get a place in the order too.
    at = np.arange(n)
    step = int(words.max()) + 2
    rank_of = doc * step + words + 1
    for k in range(1, window):
        following = np.where(at + k < end, words[np.minimum(at + k, n - 1)] + 1, 0)
        rank_of = _dense(rank_of, following)
    levels: list[tuple[np.ndarray, np.ndarray]] = []  # positions in order, their rank at length window * 2^k
    active = at[_shared(rank_of)]
    length = window
    while len(active):
        levels.append((active, rank_of[active].copy()))
        ahead = active + length
        next_rank = np.where(ahead < end[active], rank_of[np.minimum(ahead, n - 1)], -1)
        inner = _classes(rank_of[active], next_rank)
        base = rank_of[active]
        # The place inside the old class refines the rank and keeps it between those of other classes.
        lowest = np.full(n + 1, n + 1, np.int64)
        np.minimum.at(lowest, base, inner)
        rank_of[active] = base + inner - lowest[base]
        active = active[_shared(rank_of[active])]
        length *= 2
    if not levels:
        return out
    pos = levels[0][0]
    order = pos[np.argsort(rank_of[pos], kind="stable")]
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), np.int64)
    same = np.ones(len(a), bool)
    for k in range(len(levels) - 1, -1, -1):
        where, ranks = levels[k]
        size = window << k
        x, y = a + common, b + common
        rx, ry = _lookup(where, ranks, x, doc, a), _lookup(where, ranks, y, doc, b)
        same = (rx == ry) & (rx >= 0)
        common[same] += size
    # Up to window - 1 words can follow the last whole window.
    for _ in range(window - 1):
        x, y = a + common, b + common
        more = (x < end[a]) & (y < end[b]) & (doc[a] == doc[b]) & (common > 0)
        more[more] = words[x[more]] == words[y[more]]
        common[more] += 1
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return out


def _dense(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Class starts for pairs of non-negative integers in lexicographic order, with one sort where a pair fits one key."""
    span = int(low.max()) + 1
    if int(high.max()) * span >= 1 << 62:
        return _classes(high, low)
    key = high * span + low
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    out = np.empty(len(s), np.int64)
    out[order] = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    return out


def _shared(rank: np.ndarray) -> np.ndarray:
    """Whether another position has the same rank."""
    s = np.sort(rank)
    many = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(many):
        return np.zeros(len(rank), bool)
    return many[np.minimum(np.searchsorted(many, rank), len(many) - 1)] == rank


def _lookup(where: np.ndarray, ranks: np.ndarray, x: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rank of position x at a level; -1 where x is not among the level's positions or in another document than start."""
    k = np.minimum(np.searchsorted(where, x), len(where) - 1)
    ok = (where[k] == x) & (doc[np.minimum(x, len(doc) - 1)] == doc[start])
    return np.where(ok, ranks[k], -1)


def _covered(starts: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per document, the words in the union of the spans [start, start + length)."""
    n = int(counts.sum())
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    total = np.concatenate([[0], np.cumsum(np.cumsum(edge[:n]) > 0)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _dup_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(lines) == 1:
        return 0
    full = [x for x in lines if not _BLANK.fullmatch(x)]
    return len(full) - len(set(full))


def _measure(batch: pa.RecordBatch, min_repeat: int) -> dict:
    texts = texts_of(batch)
    words, counts = word_ids(texts)
    repeats = longest_repeats(words, counts)
    three = np.flatnonzero(repeats >= WINDOW)
    long = np.flatnonzero(repeats >= min_repeat)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, np.repeat(np.arange(len(texts)), counts)[long], repeats[long])
    bare = [b"".join(t.split()) for t in texts]
    return {
        "doc_id": batch.column("doc_id"), "n_words": counts,
        "word_chars": np.array([len(t.translate(None, _CONTINUATION)) for t in bare], np.int64),
        "n_symbols": np.array([len(t.translate(None, _NOT_SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([_dup_lines(t) for t in texts], np.int64),
        "n_repeat_words": _covered(three, np.full(len(three), WINDOW), counts),
        "n_covered": _covered(long, repeats[long], counts), "longest_repeat": longest,
    }


def repetition(docs: DataFrame, min_repeat: int = MIN_REPEAT) -> DataFrame:
    """One row per row of docs (doc_id, text): counts, words covered by repeats of min_repeat words or more, the longest repeat."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered long, longest_repeat long"
    return map_slices(docs.select("doc_id", "text"), "text", lambda b: _measure(b, min_repeat), schema)


def judge(measured: DataFrame, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    over = (F.col("n_covered") > max_covered * F.col("n_words")) | (F.col("longest_repeat") > max_longest * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~over)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(repetition(table(spark, sf_dir, "documents")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that the rules keep. The measures travel beside each row, so no join is needed."""

    whole = docs.select(F.struct(*docs.columns).alias("doc_id"), "text")
    return judge(repetition(whole)).where("kept").select("doc_id.*")
