"""Operator 2: benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts and benchmark items are sequences of words ([0-9a-z] and code points above 0x7F, ASCII lower
case), so spacing, punctuation and case do not matter. The CGK random walk embeds a sequence: at step j
it writes the current word and moves on by one random bit of (j, word); few edits leave two walks in
step, so edit distance becomes Hamming distance. Each repetition samples ``SAMPLES`` places of the
embedding; a window that starts at any word of a text is a candidate for an item if all sampled words
agree. Walks are lazy: their bits are hashes, made as they are needed, places are visited in order, and only windows whose sampled words so far lead to
an item are walked on. Items are grouped by length, and a group's places lie within windows of its items'
size. Unedited passages are always found this way, edited ones the less the more edits and words there are.

So that no passage within the limit is lost, each item is also cut into one segment more than it may have
edits: by pigeonhole one of them stands unedited in the text (``segment_hits``). Segments that over ``SHARED`` items have,
such as a common opening, are left out and the item cut finer, so that it still has enough others. Every occurrence of a segment gives
a stretch of text in which the item may lie. Candidates are verified by their exact edit distance in words:
at most ``MAX_EDITS`` of the item's length. Recall is 1.

The benchmark is a stated query set and goes to the tasks in blocks of at most ``BLOCK`` items and ``BLOCK_BYTES`` of text (a
longer item comes alone). Documents are scanned once per block and not shuffled; of several blocks, each one's result is
written before the next is indexed, so the driver and the tasks hold one index at a time. Its size is linear in the block's.

Defined results: null text and items without words match nothing; items of under ``SAMPLED_WORDS`` words, too short for the
sampled places, are found by their segments alone, those under five words unedited; equal items give a row
each; repeated rows are each reported; ties between windows go to the smallest distance, then start.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm.common import map_slices, table, texts_of, written

SAMPLES = 5
REPEATS = 12
MAX_EDITS = 0.2
SAMPLED_WORDS = 8
SHARED = 16  # items with one segment, above which it is no sign of any of them
BLOCK = 10_000
BLOCK_BYTES = 8_000_000
SEED = 7

#: Bytes outside [0-9a-z\x80-\xff] part words.
_BLANKS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_BLANKS).split()


def _hashes(symbols: np.ndarray, length: int) -> np.ndarray:
    """63-bit hash of every run of so many symbols."""
    n = max(len(symbols) - length + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = (out ^ symbols[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out >> np.uint64(1)).astype(np.int64)


class Walk:
    """The random bits of one repetition's walk: bit j of a word is a bit of a hash of the word and j's block."""

    def __init__(self, seed: int, vocabulary: int):
        self.seed, self.end = seed, vocabulary + 1
        self.lead = self._hash(np.arange(self.end + 1), 0)  # most walks end in the first block

    def _hash(self, symbols: np.ndarray, block: int) -> np.ndarray:
        x = (symbols.astype(np.uint64) << np.uint64(32)) ^ np.uint64((self.seed << 24 ^ block * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return np.where(symbols == self.end, np.uint64(0), x ^ (x >> np.uint64(33)))

    def bits(self, symbols: np.ndarray, j: int) -> np.ndarray:
        """Bit j of each symbol: whether a walk goes on to the next word; at a text's end it stays."""
        x = self.lead[symbols] if j < 64 else self._hash(symbols, j >> 6)
        return (x >> np.uint64(j & 63)).astype(np.int32) & 1


def _cut(ids: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(length, hash, place) of the n segments of a sequence, as even as can be."""
    edges = [i * len(ids) // n for i in range(n + 1)] if n else []
    hashes = {length: _hashes(ids, length).tolist() for length in {b - a for a, b in zip(edges, edges[1:], strict=False)}}
    return [(b - a, hashes[b - a][a], a) for a, b in zip(edges, edges[1:], strict=False)]


class Index:
    """Of a block of items: random walks and, per repetition and length group, a trie of the words at the sampled places."""

    def __init__(self, items: list[tuple[int, bytes]], samples: int = SAMPLES, repeats: int = REPEATS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        split = [(i, words_of(t)) for i, t in items]
        self.items = [(i, w) for i, w in split if w]
        self.vocabulary: dict[bytes, int] = {}
        for _, w in self.items:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary) + 1)
        self.end = len(self.vocabulary) + 1  # what follows a text's last word; walks stay there
        groups: dict[int, list[int]] = {}
        for k, (_, w) in enumerate(self.items):
            if len(w) >= SAMPLED_WORDS:
                groups.setdefault(int(np.log(len(w)) / np.log(1.25)), []).append(k)
        self.cuts: dict[float, list] = {}
        self.walks, self.tries = [], []
        for r in range(repeats if groups else 0):
            walk = Walk(seed * 1000 + r, len(self.vocabulary))
            self.walks.append(walk)
            first, tries = r % 2, []  # early places first: they cut most windows off
            for members in groups.values():
                low = min(len(self.items[k][1]) for k in members)
                second = first + 1 + int(rng.integers(4))
                places = [first, second, *sorted((second + 1 + rng.choice(2 * low - second - 1, samples - 2, replace=False)).tolist())]
                tries.append(self._trie(members, places, walk))
            self.tries.append((first, tries))

    def segments(self, max_edits: float) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per length of segments: filter of their hashes, the sorted hashes, and each one's item and place in it."""
        if max_edits not in self.cuts:
            found: dict[int, list[tuple[int, int, int]]] = {}
            for k, parts in enumerate(self._rare_parts(max_edits)):
                for length, key, low in parts:
                    found.setdefault(length, []).append((key, k, low))
            self.cuts[max_edits] = []
            for length, rows in sorted(found.items()):
                keys, items, places = (np.array(c, np.int64) for c in zip(*sorted(rows), strict=True))
                known = np.zeros(1 << 22, bool)
                known[keys & (1 << 22) - 1] = True
                self.cuts[max_edits].append((length, known, keys, items, places))
        return self.cuts[max_edits]

    def _rare_parts(self, max_edits: float) -> list[list[tuple[int, int, int]]]:
        """Segments (length, hash, place) of every item: one more than it may have edits, none of them shared by over ``SHARED`` items.

        An item with shared segments, such as an opening that many questions have, is cut finer until enough of its own are left. If even
        its single words are not enough, it keeps all of them.
        """
        ids = [np.array([self.vocabulary[w] for w in words], np.int64) for _, words in self.items]
        needed = [min(int(max_edits * len(x)) + 1, len(x)) for x in ids]
        sizes = list(needed)
        cuts = [_cut(x, n) for x, n in zip(ids, sizes, strict=True)]
        of = lambda parts: {(length, key) for length, key, _ in parts}
        counts = Counter(part for parts in cuts for part in of(parts))
        while True:
            finer = []
            for k, parts in enumerate(cuts):
                own = sum(counts[length, key] <= SHARED for length, key, _ in parts)
                if own < needed[k] and sizes[k] < len(ids[k]):
                    finer.append((k, min(len(ids[k]), max(sizes[k] + 1, needed[k] + len(parts) - own))))
            if not finer:
                break
            for k, n in finer:
                counts.subtract(of(cuts[k]))
                sizes[k], cuts[k] = n, _cut(ids[k], n)
                counts.update(of(cuts[k]))
        out = []
        for k, parts in enumerate(cuts):
            own = [p for p in parts if counts[p[0], p[1]] <= SHARED]
            out.append(own if len(own) >= needed[k] else parts)
        return out

    def segment_hits(self, symbols: np.ndarray, max_edits: float) -> list[tuple[int, int, int]]:
        """(start, item, place of the segment): where an item would start if the segments found in a sequence had no edits before them."""
        found: set[tuple[int, int, int]] = set()
        for length, known, keys, items, places in self.segments(max_edits):
            hashes = _hashes(symbols, length)
            at = np.flatnonzero(known[hashes & (1 << 22) - 1])
            first, last = (np.searchsorted(keys, hashes[at], side) for side in ("left", "right"))
            for p, low, high in zip(at.tolist(), first.tolist(), last.tolist(), strict=True):
                found.update((p - int(places[i]), int(items[i]), p) for i in range(low, high))
        return sorted(found)

    def _trie(self, members: list[int], places: list[int], walk: Walk):
        """places, and per level the sorted keys (node, word) with the items that end there."""
        levels: list[dict[int, int]] = [{} for _ in places]
        ends: list[dict[int, list[int]]] = [{} for _ in places]
        # The items walk side by side, as the windows of a text do.
        words = np.array([x for k in members for x in [self.vocabulary[w] for w in self.items[k][1]] + [self.end]], np.int32)
        sizes = np.array([len(self.items[k][1]) + 1 for k in members])
        at = np.cumsum(sizes) - sizes
        node, last = np.zeros(len(members), np.int64), [(0, 0)] * len(members)
        alive, j = np.arange(len(members)), 0
        for level, place in enumerate(places):
            while j < place:
                at[alive] += walk.bits(words[at[alive]], j)
                j += 1
            alive = alive[words[at[alive]] != self.end]  # the others' walks are over: they are found by the places before
            for i in alive.tolist():
                node[i] = levels[level].setdefault(int(node[i]) * (self.end + 1) + int(words[at[i]]), len(levels[level]))
                last[i] = (level, int(node[i]))
        for i, (level, n) in enumerate(last):
            ends[level].setdefault(n, []).append(members[i])
        tables = []
        for level in levels:
            keys = np.array(sorted(level), np.int64)
            tables.append((keys, np.array([level[x] for x in keys.tolist()], np.int64)))
        opening = np.full(self.end + 1, -1, np.int64)  # node of the first sampled word
        for key, node in levels[0].items():
            opening[key] = node
        return places, opening, tables, ends

    def candidates(self, symbols: np.ndarray) -> set[tuple[int, int]]:
        """(start, item) of all windows of a sequence whose sampled words agree with an item's."""
        found: set[tuple[int, int]] = set()
        known = np.flatnonzero(symbols != self.end).astype(np.int32)
        for walk, (first, tries) in zip(self.walks, self.tries, strict=True):
            at = known
            for j in range(first):
                at = at + walk.bits(symbols[at], j)
            some = np.zeros(self.end + 1, bool)
            for _, opening, _, _ in tries:
                some |= opening >= 0
            alive = np.flatnonzero(some[symbols[at]])
            starts, at = known[alive], at[alive]
            words = symbols[at]
            for places, opening, tables, ends in tries:
                node = opening[words]
                ok = node >= 0
                s, a, node = starts[ok], at[ok], node[ok]
                j = first
                for level, (keys, nodes) in enumerate(tables):
                    if level:
                        while j < places[level]:
                            a = a + walk.bits(symbols[a], j)
                            j += 1
                        if not len(keys):
                            break
                        key = node * (self.end + 1) + symbols[a]
                        k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                        ok = keys[k] == key
                        s, a, node = s[ok], a[ok], nodes[k[ok]]
                    if not len(s):
                        break
                    if ends[level]:
                        for start, n in zip(s.tolist(), node.tolist(), strict=True):
                            found.update((start, item) for item in ends[level].get(n, ()))
        return found


def edits_to_prefix(item: list, text: list, most: int) -> tuple[int, int] | None:
    """Least edit distance of item to a prefix of text, with the shortest such prefix; None if over most."""
    n = len(item)
    if text[:n] == item:
        return 0, n
    ends = distances(item, text[: n + most], False)
    least = min(ends)
    return (least, ends.index(least)) if least <= most else None


def distances(item: list, text: list, anywhere: bool) -> list[int]:
    """Edit distance of item to the best stretch of text that ends at each place (anywhere), or to each prefix; bit-parallel, by Myers."""
    n = len(item)
    masks: dict[int, int] = {}
    for i, word in enumerate(item):
        masks[word] = masks.get(word, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << n - 1
    plus, minus, score, out = full, 0, n, [n]
    for word in text:
        match = masks.get(word, 0)
        across = (((match & plus) + plus) ^ plus) | match | minus
        up, down = minus | ~(across | plus) & full, plus & across
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1 | (not anywhere)) & full, down << 1 & full
        vertical = match | minus
        plus, minus = down | ~(vertical | up) & full, up & vertical
        out.append(score)
    return out


def best_stretch(item: list, text: list, most: int) -> tuple[int, int, int] | None:
    """(edits, start, words) of the stretch of text nearest to item, the first and then the shortest of equals; None if over most."""
    ends = distances(item, text, True)
    least = min(ends)
    if least > most:
        return None
    back = item[::-1]
    stretches = []
    for end, d in enumerate(ends):
        if d == least:
            low = max(0, end - len(item) - least)
            lengths = distances(back, text[low:end][::-1], False)
            stretches += [(least, end - n, n) for n, e in enumerate(lengths) if e == least]
    return min(stretches)


def leaks_in(texts: list[bytes], index: Index, max_edits: float) -> list[list[tuple[int, int, int, int]]]:
    """For each text (item_id, start, n_words, edits) of every item found, by item_id then start."""
    get = index.vocabulary.get
    symbols, lengths = [], []
    for text in texts:
        ids = [get(w, 0) for w in words_of(text)]
        symbols += ids
        symbols.append(index.end)
        lengths.append(len(ids) + 1)
    out: list[list] = [[] for _ in texts]
    if not index.items or not symbols:
        return out
    array = np.array(symbols, np.int32)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    best: dict[tuple[int, int], tuple] = {}
    for start, k in index.candidates(array):
        row = int(np.searchsorted(offsets, start, side="right")) - 1
        item_id, words = index.items[k]
        item = [index.vocabulary[w] for w in words]
        most = int(max_edits * len(item))
        text = symbols[start : min(start + len(item) + most, int(offsets[row + 1]) - 1)]
        if hit := edits_to_prefix(item, text, most):
            found = (hit[0], start - int(offsets[row]), hit[1])
            if (row, k) not in best or found < best[row, k]:
                best[row, k] = found
    reached: dict[tuple[int, int], int] = {}  # how far a row's text is searched for an item
    for start, k, place in index.segment_hits(array, max_edits):
        row = int(np.searchsorted(offsets, place, side="right")) - 1
        words = index.items[k][1]
        most = int(max_edits * len(words))
        base, end = int(offsets[row]), int(offsets[row + 1]) - 1
        low, high = max(base, start - most), min(end, start + len(words) + most)
        if reached.get((row, k), -1) >= high or (row, k) in best and best[row, k][0] == 0 and best[row, k][1] <= low - base:
            continue
        reached[row, k] = high
        if hit := best_stretch([index.vocabulary[w] for w in words], symbols[low:high], most):
            found = (hit[0], low - base + hit[1], hit[2])
            if (row, k) not in best or found < best[row, k]:
                best[row, k] = found
    for (row, k), (edits, start, n) in best.items():
        out[row].append((index.items[k][0], start, n, edits))
    return [sorted(x, key=lambda h: (h[0] is None, h[0] or 0, h[1])) for x in out]


def indexes(benchmark: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> Iterator[Index]:
    """The benchmark's items in blocks, each indexed. This is the stated query set; its rows are read block by block."""
    part: list[tuple[int, bytes]] = []
    size = 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        text = (row["text"] or "").encode()
        if part and (len(part) == block or size + len(text) > block_bytes):
            yield Index(part)
            part, size = [], 0
        part.append((row["item_id"], text))
        size += len(text)
    yield Index(part)


def annotate(docs: DataFrame, index: Index, max_edits: float = MAX_EDITS) -> DataFrame:
    """Rows of docs in the struct column ``row`` with ``leaks``, an array of the items found in its text."""
    index.segments(max_edits)  # built once, here
    kind = docs.schema.simpleString()
    leak = "struct<item_id:bigint,start:bigint,n_words:bigint,edits:bigint>"
    names = ("item_id", "start", "n_words", "edits")

    def make(batch: pa.RecordBatch) -> dict:
        return {"row": batch.column("row"), "leaks": [[dict(zip(names, h, strict=True)) for h in hits] for hits in leaks_in(texts_of(batch), index, max_edits)]}

    return map_slices(docs.select(F.struct("*").alias("row"), "text"), "text", make, f"row {kind}, leaks array<{leak}>")


def find_leaks(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, start, n_words, edits: a row per document and item that its text contains."""
    docs, out, last = docs.select("doc_id", "text"), None, None
    for index in indexes(benchmark, block):
        if last is not None:
            out = written(last) if out is None else out.unionByName(written(last))
        last = annotate(docs, index, max_edits).select("row.doc_id", F.inline("leaks"))
    return last if out is None else out.unionByName(last)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that contain no benchmark item."""
    last = None
    for index in indexes(table(spark, sf_dir, "benchmark")):
        docs = docs if last is None else written(last)
        last = annotate(docs, index).where(F.size("leaks") == 0).select("row.*")
    return last
