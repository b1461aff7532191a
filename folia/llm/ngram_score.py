"""Operator 10: language-model scoring with an Elias-Fano n-gram trie.

A trigram model with Dirichlet smoothing. For a token w after u and v:
P(w | u v) = (c(u v w) + MU3 * P(w | v)) / (c(u v) + MU3) and P(w | v) = (c(v w) + MU2 * p(w)) / (c(v) + MU2). The unigram
model p is add-one for tokens of the table (over ``COMMON`` of all training tokens, so at most 1 / ``COMMON`` of them); the
others share the rest evenly, one unknown token included. A text's end stands for the two contexts of its start.

The log of a text splits into terms that belong to one bigram each: log(c(u v w) + MU3 * P(w | v)) - log(c(v w) + MU3), the
second for (v, w) as the context of what follows. So whoever owns a bigram (v, w) with its contexts u, and knows c(v), holds
all that its terms need. Bigrams are owned by hash, those of one rare v (not in the table) together, as c(v) is counted there.

Spark counts the training tokens, with the pairs that are frequent in a slice of texts beside them; that gives the table and
the hot pairs. A second pass numbers the tokens (tables' places, or digests) and sends each token with its two predecessors,
packed per slice and partition, to the owner. A hot pair is spread over ``SALTS`` owners by u; every slice sends its count
of the pair to all of them. The owner sorts the training n-grams into a trie of three levels (v; w below v; u below both)
of Elias-Fano sequences and monotone Elias-Fano pointers, with quantised log probabilities, in scratch files that
it maps into memory, and answers all texts' n-grams from it by a successor search relative to their context's range. Sums
per text go back packed per slice. A shard has about ``SHARD`` tokens whatever the size of the corpus; a partition with
several shards (over ``PARTITIONS`` in all) splits what it reads by shard; rows over ``SPOOL`` bytes wait in scratch files. Base scores are summed where a
slice is read for tokens of the table; rare tokens are counted by their owner.

Tokens of the table are numbers, the others 63-bit digests.

Defined results: null text has one token, its end; a null doc_id is trained on (its id counts as '');
rows that repeat id and text get the same scores; an empty training set gives p = 1 / (N + V + 1).
"""

from __future__ import annotations

import os
import pickle
import tempfile
import zlib
from collections.abc import Callable, Iterator
from copy import copy
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folia.llm.common import cut, numbered, slices, table

MU2, MU3 = 1000.0, 16.0
COMMON = 1e-6
HOT = 1e-4  # share of all training tokens above which a pair is hot; at most 2 / HOT pairs
SALTS = 16
SHARD = 2_500_000
PARTITIONS = 4096
FOLDS, HELD_OUT = 7, 2
SLICE = 12_000_000
CHUNK = 1 << 20
SPOOL = 64 << 20  # bytes of packed rows that a task holds before it files them
END = xxhash.xxh64_intdigest(b"\n", 42)  # no word contains a newline
LEVELS = 1 << 16  # quantised log probabilities
RARE = np.uint64(1 << 63)


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all texts' tokens, each text's end included; the numbered tokens' digests; the number of tokens of each text."""
    split = [t.lower().split() for t in texts]
    counts = np.array([len(w) + 1 for w in split], np.int64)
    flat: list[bytes] = []
    for w in split:
        flat += w
        flat.append(b"\n")
    codes, words = numbered(flat)
    digest = xxhash.xxh64_intdigest
    return codes, np.array([digest(w, 42) for w in words], np.uint64), counts


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def _before(codes: np.ndarray, counts: np.ndarray, end: int) -> np.ndarray:
    """The token before each token; a text's first has the end."""
    out = np.empty_like(codes)
    out[1:] = codes[:-1]
    out[np.cumsum(counts) - counts] = end
    return out


def _frequent_pairs(codes: np.ndarray, counts: np.ndarray, types: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of token numbers with over HOT / 2 of a slice's tokens, and their counts."""
    least = HOT / 2 * len(codes)
    often = np.bincount(codes, minlength=types) > least
    before = _before(codes, counts, int(codes[-1]))
    both = np.flatnonzero(often[codes] & often[before])
    key, n = np.unique(before[both] * types + codes[both], return_counts=True)
    key, n = key[n > least], n[n > least]
    return key // types, key % types, n


def token_counts(docs: DataFrame) -> DataFrame:
    """token, second, n over the training texts: tokens (second null), and pairs with the counts of the slices in which they are frequent."""

    def run(batches):
        seen, many = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        pairs: dict[tuple[int, int], int] = {}
        for part in slices(batches, "text", SLICE):
            train = [t for t, i in zip(_texts(part), part.column("doc_id").to_pylist(), strict=True) if not held_out(i)]
            if train:
                codes, got, counts = tokens(train)
                for a, b, n in zip(*(x.tolist() for x in _frequent_pairs(codes, counts, len(got))), strict=True):
                    pair = (int(got[a]), int(got[b]))
                    pairs[pair] = pairs.get(pair, 0) + n
                seen, inverse = np.unique(np.concatenate([seen, got]), return_inverse=True)
                many = np.bincount(inverse, np.concatenate([many, np.bincount(codes, minlength=len(got))]), len(seen)).astype(np.int64)
        names = ["token", "second", "n"]
        for k in range(0, len(seen), 100_000):
            part = seen[k : k + 100_000].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.nulls(len(part), pa.int64()), pa.array(many[k : k + 100_000])], names=names)
        if pairs:
            both = np.array(list(pairs), np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.array(list(pairs.values()), np.int64))], names=names)

    return docs.mapInArrow(run, "token long, second long, n long").groupBy("token", "second").agg(F.sum("n").alias("n"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def _small(x: np.ndarray) -> bytes:
    """Bytes of non-negative integers in the narrowest of 1, 2 and 4 bytes; _wide reads them by their number."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32).tobytes()


def _wide(data: bytes, number: int) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(data) // number if number else 1]).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """Integers below 2^32 as byte planes, lowest first: the high planes of frequent tokens are zeros, which compress."""
    width = 4 if len(x) and int(x.max()) >= 1 << 24 else 3
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T).tobytes()


def _from_planes(data: bytes, number: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(len(data) // number if number else 3, number)
    out = planes[0].astype(np.int64)
    for k in range(1, len(planes)):
        out |= planes[k].astype(np.int64) << 8 * k
    return out


class Common:
    """What all tasks know: the table (digests by descending count, with counts), the hot pairs, and the totals."""

    def __init__(self, digests: np.ndarray, counts: np.ndarray, hot: np.ndarray, total: int, types: int, texts: int, shards: int):
        self.counts, self.total, self.types, self.texts = counts, total, types, texts
        self.order = np.argsort(digests).astype(np.int32)
        self.sorted = digests[self.order]
        self.shards, self.partitions = shards, min(shards, PARTITIONS)
        self.scale = total + types + 1
        rest = (self.scale - float((counts + 1).sum())) / self.scale / (types - len(counts) + 1)
        self.prior = np.append((counts + 1) / self.scale, rest)  # by place in the table; the last for all others
        names = self.names(hot.ravel()).reshape(hot.shape)
        names = names[(names < RARE).all(axis=1)]
        self.hot = np.sort(names[:, 0] << np.uint64(32) | names[:, 1])
        self.end = self.names(np.array([END], np.uint64))[0]

    def names(self, digests: np.ndarray) -> np.ndarray:
        """Places in the table, or digests with the highest bit set."""
        if not len(self.sorted):
            return digests | RARE
        k = np.minimum(np.searchsorted(self.sorted, digests), len(self.sorted) - 1)
        return np.where(self.sorted[k] == digests, self.order[k].astype(np.uint64), digests | RARE)

    def prior_of(self, names: np.ndarray) -> np.ndarray:
        return self.prior[np.where(names < RARE, names, np.uint64(len(self.counts))).astype(np.int64)]

    def is_hot(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(first), bool)
        key = np.where((first | second) < RARE, first << np.uint64(32) | second, RARE)
        k = np.minimum(np.searchsorted(self.hot, key), len(self.hot) - 1)
        return self.hot[k] == key

    def owner(self, first: np.ndarray, second: np.ndarray, hot: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """Shards of pairs; rare first tokens keep theirs together, hot pairs spread by salt."""
        x = _mix(first)
        x = np.where(first < RARE, _mix(x ^ second * np.uint64(0x9E3779B97F4A7C15)), x)
        x = x % np.uint64(self.shards)
        return np.where(hot, (x + salt % np.uint64(SALTS) * np.uint64(self.shards // SALTS + 1)) % np.uint64(self.shards), x).astype(np.int64)

    def owner_of_rare(self, names: np.ndarray) -> np.ndarray:
        return (_mix(names) % np.uint64(self.shards)).astype(np.int64)


#: One slice's n-grams for one partition. Tokens are places in the table, or its length and a place in ``rare``. n-grams
#: stand in order of their texts, ``runs`` says how many each of ``texts`` (places in the slice) has. lone_*: rare tokens
#: to be counted, with their text among ``texts``. pair_*: the slice's counts of hot pairs. One partition of a slice
#: gets what is known of its texts: ids and the sums over the tokens of the table.
FIELDS = ("first", "second", "older", "rare", "texts", "runs", "train", "lone", "lone_runs", "lone_text", "pair_first", "pair_second", "pair_n",
    "n_tokens", "held", "known", "base")
PIECE = FIELDS[:10]  # what an owner reads of a row, its pairs aside
HEAD = ("n_tokens", "held", "known", "base")


def _pack(part: pa.RecordBatch, common: Common) -> list[tuple[int, dict]]:
    """(partition, fields) of one slice, without its ids; the first one is to carry them."""
    codes, digests, counts = tokens(_texts(part))
    names = common.names(digests)
    last = int(codes[-1])
    before = _before(codes, counts, last)
    older = _before(before, counts, last)
    text = np.repeat(np.arange(len(counts)), counts)
    train = np.array([not held_out(i) for i in part.column("doc_id").to_pylist()])
    first, second = names[before], names[codes]
    hot = common.is_hot(first, second)
    shard = common.owner(first, second, hot, _mix(names)[older])
    home = shard % common.partitions
    order = np.argsort(home.astype(np.uint16), kind="stable")
    bounds = np.searchsorted(home[order], np.arange(common.partitions + 1))
    # Rare tokens, to be counted where they belong.
    is_rare = names >= RARE
    alone = np.flatnonzero(is_rare[codes])
    to = common.owner_of_rare(names) % common.partitions
    alone = alone[np.lexsort((codes[alone], to[codes[alone]]))]
    its = to[codes[alone]]
    lone_bounds = np.searchsorted(its, np.arange(common.partitions + 1))
    # Counts of hot pairs, for each of their owners.
    learned = np.flatnonzero(hot & train[text])
    key, n = np.unique(before[learned] * len(names) + codes[learned], return_counts=True)
    pair = np.stack([key // len(names), key % len(names)]).repeat(SALTS, axis=1)
    salted = common.owner(names[pair[0]], names[pair[1]], np.ones(pair.shape[1], bool), np.tile(np.arange(SALTS, dtype=np.uint64), len(key))) % common.partitions
    to = np.unique(np.stack([salted, pair[0], pair[1]]), axis=1)
    pair_n = n[np.searchsorted(key, to[1] * len(names) + to[2])]
    pair_home = to[0]
    place = np.where(is_rare, 0, names).astype(np.int64)
    local = np.full(len(names), -1, np.int64)
    out = []
    head = int(_mix(np.array([int(digests.sum(dtype=np.uint64))], np.uint64))[0] % np.uint64(common.partitions))
    used = np.flatnonzero(np.diff(bounds) + np.diff(lone_bounds) + np.bincount(pair_home, minlength=common.partitions))
    for k in sorted({head, *used.tolist()}, key=lambda k: (k != head, k)):
        items, lone = order[bounds[k] : bounds[k + 1]], alone[lone_bounds[k] : lone_bounds[k + 1]]
        parts = [x[items] for x in (before, codes, older)]
        rare = np.unique(np.concatenate([x[is_rare[x]] for x in parts]))
        local[rare] = np.arange(len(rare)) + len(common.counts)
        here = np.unique(np.concatenate([text[items], text[lone]]))
        new = np.flatnonzero(np.append(True, codes[lone][1:] != codes[lone][:-1])) if len(lone) else np.zeros(0, np.int64)
        pairs = np.flatnonzero(pair_home == k)
        fields = dict(zip(("first", "second", "older"), (_planes(np.where(is_rare[x], local[x], place[x])) for x in parts), strict=True))
        fields |= {
            "rare": names[rare].tobytes(), "texts": _small(here), "train": train[here].tobytes(),
            "runs": _small(np.bincount(np.searchsorted(here, text[items]), minlength=len(here))),
            "lone": names[codes[lone[new]]].tobytes(), "lone_runs": _small(np.diff(np.append(new, len(lone)))), "lone_text": _small(np.searchsorted(here, text[lone])),
            "pair_first": _planes(place[to[1][pairs]]), "pair_second": _planes(place[to[2][pairs]]), "pair_n": pair_n[pairs].astype(np.uint32).tobytes(),
        }
        out.append((k, fields))
    in_table = np.flatnonzero(~is_rare[codes])
    logs = np.log10(common.counts[place[codes[in_table]]] + 1)
    out[0][1].update(
        n_tokens=_small(counts), held=(~train).tobytes(),
        known=_small(np.bincount(text[in_table], minlength=len(counts))), base=np.bincount(text[in_table], logs, len(counts)).tobytes(),
    )
    return out


def packed(docs: DataFrame, common: Common) -> DataFrame:
    """Rows of ``FIELDS`` with partition, slice and ids, for docs (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"partition int, slice bigint, ids array<{kind}>, {', '.join(f'{f} binary' for f in FIELDS)}"

    def run(batches):
        name = count(TaskContext.get().partitionId() << 32)
        for part in slices(batches, "text", SLICE):
            rows, number = _pack(part, common), next(name)
            ids = part.column("doc_id")
            lists = pa.ListArray.from_arrays(pa.array([0] + [len(ids)] * len(rows), pa.int32()), ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in rows], pa.int32()), pa.array([number] * len(rows), pa.int64()), lists,
                    *[pa.array([x.get(f, b"") for _, x in rows], pa.binary()) for f in FIELDS]],
                names=["partition", "slice", "ids", *FIELDS],
            )

    return docs.mapInArrow(run, schema)


def _mapped(values: np.ndarray, folder: str, name: str) -> np.ndarray:
    path = os.path.join(folder, name + ".npy")
    np.save(path, values)
    return np.load(path, mmap_mode="r")


class EliasFano:
    """A monotone sequence of integers: low bits packed, high bits as unary gaps in a bit vector with a rank directory."""

    def __init__(self, values: np.ndarray, folder: str, name: str):
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        self.n, self.low_bits = n, max(0, (top // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        ones = (values >> np.uint64(self.low_bits)).astype(np.int64) + np.arange(n)
        high = np.packbits(np.bincount(ones, minlength=64).astype(np.uint8), bitorder="little")
        words = np.frombuffer(high.tobytes() + bytes(-len(high) % 8), np.uint64)
        directory = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int64)
        low = self._packed_low(values & np.uint64((1 << self.low_bits) - 1))
        self.low, self.words, self.directory = (_mapped(a, folder, f"{name}{k}") for k, a in enumerate((low, words, directory)))

    def _packed_low(self, low: np.ndarray) -> np.ndarray:
        bit = np.arange(self.n, dtype=np.int64) * self.low_bits
        out = np.zeros((self.n * self.low_bits >> 6) + 2, np.uint64)
        if self.low_bits and self.n:
            shift, word = (bit & 63).astype(np.uint64), bit >> 6
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            # Parts of one word have no bit in common: their sum joins them.
            out[word[start]] += np.add.reduceat(low << shift, start)
            over = np.where(shift > 0, low >> (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
            out[word[start] + 1] += np.add.reduceat(over, start)
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        shift, word = (bit & 63).astype(np.uint64), bit >> 6
        over = np.where(shift > 0, self.low[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return (self.low[word] >> shift | over) & np.uint64((1 << self.low_bits) - 1)

    def values(self, begin: int, end: int) -> np.ndarray:
        """The values at the places from begin to end."""
        first, last = (int(np.searchsorted(self.directory, k, side="right")) - 1 for k in (begin, max(begin, end - 1)))
        bits = np.unpackbits(np.asarray(self.words[first : last + 1]).view(np.uint8), bitorder="little")
        skip = begin - int(self.directory[first])
        at = np.flatnonzero(bits)[skip : skip + end - begin] + first * 64
        i = np.arange(begin, end)
        return (at - i).astype(np.uint64) << np.uint64(self.low_bits) | self._low(i)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at any places: select the i-th one, then join the low bits."""
        word = np.searchsorted(self.directory, i, side="right") - 1
        rest = (i - self.directory[word]).astype(np.uint64)
        bits, at = self.words[word], np.zeros(len(i), np.uint64)
        for width in (32, 16, 8, 4, 2, 1):
            part = bits & np.uint64((1 << width) - 1)
            ones = np.bitwise_count(part).astype(np.uint64)
            beyond = rest >= ones
            rest = np.where(beyond, rest - ones, rest)
            bits = np.where(beyond, bits >> np.uint64(width), part)
            at += np.where(beyond, np.uint64(width), np.uint64(0))
        return (word.astype(np.uint64) * np.uint64(64) + at - i.astype(np.uint64)) << np.uint64(self.low_bits) | self._low(i)

    def successor(self, begin: np.ndarray, end: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In each range [begin, end), the first place whose value is not below the given one (end if there is none), and whether it is equal.

        The sequence is decoded run by run; as it is monotone, a range's successor is that of the sequence, moved into the range.
        """
        at, equal = np.zeros(len(value), np.int64), np.zeros(len(value), bool)
        starts = np.arange(0, self.n, CHUNK)
        lead = self.get(starts)
        run = np.searchsorted(lead, value) - 1  # the last run that begins below the value
        if self.n:
            equal[run < 0] = value[run < 0] == lead[0]
        for k in np.unique(run[run >= 0]).tolist():
            mine = np.flatnonzero(run == k)
            values = self.values(k * CHUNK, min((k + 2) * CHUNK - CHUNK + 1, self.n))  # and the first one of the next run
            found = np.searchsorted(values, value[mine])
            at[mine] = k * CHUNK + found
            equal[mine] = values[np.minimum(found, len(values) - 1)] == value[mine]
        inside = np.clip(at, begin, end)
        return inside, equal & (inside == at) & (at < end)


class Words:
    """The distinct names of a shard's training n-grams, and their numbers in order."""

    def __init__(self, arrays: list[np.ndarray], common: Common, folder: str):
        seen, rare = np.zeros(len(common.counts) + 1, bool), []
        for x in arrays:
            inside = x < RARE
            seen[x[inside].astype(np.int64)] = True
            rare.append(np.unique(x[~inside]))
        table = np.flatnonzero(seen)
        lookup = np.full(len(seen), -1, np.int32)
        lookup[table] = np.arange(len(table))
        self.table, self.lookup = table.astype(np.uint64), _mapped(lookup, folder, "lookup")
        self.rare = _mapped(np.unique(np.concatenate(rare)) if rare else np.zeros(0, np.uint64), folder, "rare")
        self.size = len(table) + len(self.rare)

    def number(self, names: np.ndarray) -> np.ndarray:
        """Numbers of names, -1 for those that are not among the words."""
        inside = names < RARE
        out = np.full(len(names), -1, np.int64)
        out[inside] = self.lookup[names[inside].astype(np.int64)]
        outside = np.flatnonzero(~inside)
        if len(self.rare) and len(outside):
            x = names[outside]
            k = np.minimum(np.searchsorted(self.rare, x), len(self.rare) - 1)
            out[outside] = np.where(self.rare[k] == x, k + len(self.table), -1)
        return out

    def name(self, numbers: np.ndarray) -> np.ndarray:
        return np.concatenate([self.table, self.rare])[numbers]


def _distinct(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of columns of non-negative integers in order, and how often each occurs; sorted as single integers where they fit."""
    widths = [max(1, int(c.max(initial=0)).bit_length()) for c in columns]
    if sum(widths) > 63:
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        first = np.flatnonzero(new)
        return [c[first] for c in columns], np.diff(np.append(first, len(order)))
    key = np.zeros(len(columns[0]), np.int64)
    for c, w in zip(columns, widths, strict=True):
        key = key << w | c
    key, n = np.unique(key, return_counts=True)
    out = []
    for w in reversed(widths):
        out.append(key & ((1 << w) - 1))
        key = key >> w
    return out[::-1], n


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Whether each place of sorted columns begins a new run of equal rows."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


class Trie:
    """Tokens v with their training successors w and, below each pair, the older tokens u: monotone pointers and quantised log10 of smoothed probabilities."""

    def __init__(self, first: np.ndarray, second: np.ndarray, older: np.ndarray, common: Common, pairs: dict[tuple[int, int], int], folder: str):
        """Names of v, w, u of every training n-gram; pairs: counts of the hot pairs."""
        # Hot pairs get their place also where all their training n-grams are other owners'.
        hot = np.array(list(pairs), np.uint64).reshape(-1, 2)
        self.words = Words([first, second, older, hot.ravel()], common, folder)
        size = self.words.size
        (v, w, u), n = _distinct(*(self.words.number(x) for x in (first, second, older)))
        key, hot_key = v * size + w, self.words.number(hot[:, 0]) * size + self.words.number(hot[:, 1])
        key2 = np.unique(np.concatenate([key, hot_key]))
        bounds2 = np.append(np.searchsorted(key, key2), len(key))
        c2 = np.diff(np.append(0, np.cumsum(n))[bounds2])
        c2[np.searchsorted(key2, hot_key)] = np.fromiter(pairs.values(), np.int64, len(pairs))
        v2, w2 = np.divmod(key2, max(size, 1))
        start1 = np.flatnonzero(_starts(v2))
        c1 = np.add.reduceat(c2, start1) if len(c2) else c2
        names_v, names_w = self.words.name(v2[start1]), self.words.name(w2)
        in_table = names_v < RARE
        c1[in_table] = common.counts[names_v[in_table].astype(np.int64)]
        parent1 = np.repeat(np.arange(len(start1)), np.diff(np.append(start1, len(v2))))
        parent2 = np.repeat(np.arange(len(key2)), np.diff(bounds2))
        self.heads = EliasFano(v2[start1], folder, "heads")
        self.pointers1 = EliasFano(np.append(start1, len(v2)), folder, "pointers1")
        self.level2 = EliasFano(parent1 * size + w2, folder, "level2")
        self.pointers2 = EliasFano(bounds2, folder, "pointers2")
        self.level3 = EliasFano(parent2 * size + u, folder, "level3")
        p2 = (c2 + MU2 * common.prior_of(names_w)) / (c1[parent1] + MU2)
        self.backoff = self._codes(np.log10(MU2 / (c1 + MU2)), folder, "backoff")
        self.low = self._codes(np.log10(p2), folder, "low")
        self.weight = self._codes(np.log10(c2 + MU3), folder, "weight")
        self.high = self._codes(np.log10(n + MU3 * p2[parent2]), folder, "high")

    @staticmethod
    def _codes(logs: np.ndarray, folder: str, name: str) -> tuple[np.ndarray, float, float]:
        base = float(logs.min(initial=np.inf)) if len(logs) else 0.0
        step = ((float(logs.max()) - base) / (LEVELS - 1) or 1.0) if len(logs) else 1.0
        return _mapped(np.rint((logs - base) / step).astype(np.uint16), folder, name), base, step

    @staticmethod
    def _logs(codes: tuple[np.ndarray, float, float], at: np.ndarray) -> np.ndarray:
        return codes[1] + codes[2] * codes[0][at].astype(float)

    @staticmethod
    def _below(pointers: EliasFano, level: EliasFano, size: int, parent: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of children in the ranges of their parents, and whether they are there."""
        # Each pointer that is asked for is selected once, in order.
        wanted = np.zeros(pointers.n, bool)
        wanted[parent] = wanted[parent + 1] = True
        asked = np.flatnonzero(wanted)
        place = np.cumsum(wanted, dtype=np.int32)
        bounds = pointers.get(asked).astype(np.int64)
        return level.successor(bounds[place[parent] - 1], bounds[place[parent + 1] - 1], (parent * size + child).astype(np.uint64))

    def find(self, first: np.ndarray, second: np.ndarray, older: np.ndarray, common: Common) -> tuple[np.ndarray, np.ndarray]:
        """For names of v, w, u: log10(c(u v w) + MU3 P(w | v)) and log10(c(v w) + MU3)."""
        v, w, u = (self.words.number(x) for x in (first, second, older))
        # A pair's v that the trie has not can still be a token of the table, with its training pairs at other owners.
        seen = np.zeros(len(first))
        inside = first < RARE
        seen[inside] = common.counts[first[inside].astype(np.int64)]
        out = np.log10(MU2 / (seen + MU2))
        weight = np.full(len(first), np.log10(MU3))
        ask = np.flatnonzero(v >= 0)
        zero = np.zeros(len(ask), np.int64)
        head, hit = self.heads.successor(zero, zero + self.heads.n, v[ask].astype(np.uint64))
        ask, head = ask[hit], head[hit]
        out[ask] = self._logs(self.backoff, head)
        out += np.log10(common.prior_of(second)) + np.log10(MU3)
        ask, head = ask[w[ask] >= 0], head[w[ask] >= 0]
        pair, hit = self._below(self.pointers1, self.level2, self.words.size, head, w[ask])
        ask, pair = ask[hit], pair[hit]
        out[ask] = self._logs(self.low, pair) + np.log10(MU3)
        weight[ask] = self._logs(self.weight, pair)
        ask, pair = ask[u[ask] >= 0], pair[u[ask] >= 0]
        leaf, hit = self._below(self.pointers2, self.level3, self.words.size, pair, u[ask])
        out[ask[hit]] = self._logs(self.high, leaf[hit])
        return out, weight


class Piece:
    """A packed row, read: the names of v, w, u per n-gram with the place of its text, and the rare tokens."""

    def __init__(self, row: dict, size: int):
        rare = np.frombuffer(row["rare"], np.uint64)
        self.slice, self.texts, self.train = row["slice"], row["texts"], np.frombuffer(row["train"], bool)
        runs = _wide(row["runs"], len(self.train))
        self.text = np.repeat(np.arange(len(runs)), runs)
        self.first, self.second, self.older = (self._names(_from_planes(row[f], len(self.text)), size, rare) for f in ("first", "second", "older"))
        lone = np.frombuffer(row["lone"], np.uint64)
        runs = _wide(row["lone_runs"], len(lone))
        self.lone, self.lone_text = np.repeat(lone, runs), _wide(row["lone_text"], int(runs.sum()))

    @staticmethod
    def _names(places: np.ndarray, size: int, rare: np.ndarray) -> np.ndarray:
        out = places.astype(np.uint64)
        at = np.flatnonzero(places >= size)
        out[at] = rare[places[at] - size]
        return out

    def of_shard(self, sub: int, common: Common) -> Piece:
        """What the sub-th shard of the partition owns."""
        out = copy(self)
        owner = common.owner(self.first, self.second, common.is_hot(self.first, self.second), _mix(self.older))
        mine = owner // common.partitions == sub
        out.text, out.first, out.second, out.older = (x[mine] for x in (self.text, self.first, self.second, self.older))
        mine = common.owner_of_rare(self.lone) // common.partitions == sub
        out.lone, out.lone_text = self.lone[mine], self.lone_text[mine]
        return out


def _shard_scores(pieces: Callable[[], Iterator[Piece]], pairs: dict[tuple[int, int], int], common: Common) -> Iterator[dict]:
    """Per piece: its slice and texts, the sums of their n-grams, and the known rare tokens with their base sums."""
    learned: list[list[np.ndarray]] = [[], [], [], []]
    for p in pieces():
        train = p.train[p.text]
        for column, x in zip(learned, (p.first[train], p.second[train], p.older[train], p.lone[p.train[p.lone_text]]), strict=True):
            column.append(x)
    first, second, older, lone = (np.concatenate(c) if c else np.zeros(0, np.uint64) for c in learned)
    del learned
    rare, n_rare = np.unique(lone, return_counts=True)
    with tempfile.TemporaryDirectory() as folder:
        trie = Trie(first, second, older, common, pairs, folder)
        del first, second, older, lone
        group: list[Piece] = []
        every = pieces()
        while True:  # the levels are decoded once per CHUNK n-grams
            piece = next(every, None)
            if piece:
                group.append(piece)
            if group and (piece is None or sum(len(p.text) for p in group) >= CHUNK):
                number, weight = trie.find(*(np.concatenate([getattr(p, f) for p in group]) for f in ("first", "second", "older")), common)
                at = 0
                for p in group:
                    n, last = len(p.text), p.second == common.end
                    term = number[at : at + n] - np.where(last, 0, weight[at : at + n])
                    at += n
                    count_of = np.zeros(len(p.lone), np.int64)
                    if len(rare):
                        k = np.minimum(np.searchsorted(rare, p.lone), len(rare) - 1)
                        count_of = np.where(rare[k] == p.lone, n_rare[k], 0)
                    seen = np.flatnonzero(count_of)
                    alone = np.unique(p.lone_text[seen])
                    where = np.searchsorted(alone, p.lone_text[seen])
                    yield {
                        "slice": p.slice, "texts": p.texts, "sums": np.bincount(p.text, term, len(p.train)).astype(np.float32).tobytes(),
                        "rare": _small(alone), "known": _small(np.bincount(where, minlength=len(alone))),
                            "base": np.bincount(where, np.log10(count_of[seen] + 1), len(alone)).tobytes(),
                    }
                group = []
            if piece is None:
                break
        del trie


class Spool:
    """Items in order: the first ones in a scratch file once they take more than ``limit`` bytes, the last ones in memory."""

    def __init__(self, path: str, limit: int):
        self.path, self.limit, self.items, self.size, self.filed = path, limit, [], 0, 0

    def add(self, item, size: int) -> None:
        self.items.append(item)
        self.size += size
        if self.size > self.limit:
            with open(self.path, "ab") as file:
                for x in self.items:
                    pickle.dump(x, file)
            self.filed += len(self.items)
            self.items, self.size = [], 0

    def __iter__(self) -> Iterator:
        if self.filed:
            with open(self.path, "rb") as file:
                for _ in range(self.filed):
                    yield pickle.load(file)  # noqa: S301
        yield from self.items


def _partition_scores(rows: Iterator[dict], common: Common) -> Iterator[dict]:
    """Scores of a partition's packed rows; the heads of slices go through. Rows are taken one by one; what waits is spooled, by shard."""
    size, pairs = len(common.counts), {}
    subs = -(-common.shards // common.partitions)
    with tempfile.TemporaryDirectory() as folder:
        spools = [Spool(os.path.join(folder, str(k)), SPOOL // subs) for k in range(subs)]
        for r in rows:
            n = np.frombuffer(r["pair_n"], np.uint32).tolist()
            for v, w, k in zip(_from_planes(r["pair_first"], len(n)).tolist(), _from_planes(r["pair_second"], len(n)).tolist(), n, strict=True):
                pairs[v, w] = pairs.get((v, w), 0) + k
            if r["ids"]:
                yield {"slice": r["slice"], "ids": r["ids"]} | {f: r[f] for f in HEAD}
            if subs == 1:
                spools[0].add({f: r[f] for f in ("slice", *PIECE)}, sum(len(r[f]) for f in PIECE))
                continue
            piece = Piece(r, size)
            for k, spool in enumerate(spools):
                mine = piece.of_shard(k, common)
                spool.add(mine, 32 * len(mine.text) + 16 * len(mine.lone) + 8 * len(mine.train))
        for spool in spools:
            yield from _shard_scores(lambda s=spool: (x if subs > 1 else Piece(x, size) for x in s), pairs, common)


def _slice_sums(parts: pa.Table, common: Common) -> pa.Table:
    """A slice's texts with the sums over all shards: doc_id, held_out, n_tokens, n_known, base, joint. A slice is a bounded run of texts."""
    rows = parts.to_pylist()
    head = next(r for r in rows if r["ids"])
    ids = next(x for x in parts.column("ids").combine_chunks() if x.is_valid and len(x)).values
    held = np.frombuffer(head["held"], bool)
    n_tokens = _wide(head["n_tokens"], len(held))
    known = _wide(head["known"], len(held))
    base = np.frombuffer(head["base"]).copy()
    joint = np.full(len(held), -np.log10(common.texts + MU3))
    for r in rows:
        if r["ids"]:
            continue
        sums = np.frombuffer(r["sums"], np.float32)
        at = _wide(r["texts"], len(sums))
        joint[at] += sums
        more = np.frombuffer(r["base"])
        at = at[_wide(r["rare"], len(more))]
        base[at] += more
        known[at] += _wide(r["known"], len(more))
    return pa.table({"doc_id": ids, "held_out": held, "n_tokens": n_tokens, "n_known": known, "base_score": base - n_tokens * np.log10(common.scale), "score": joint})


def learn(docs: DataFrame, shard: int) -> Common:
    """The totals, the table of common tokens and the hot pairs of the training texts; at most 1 / COMMON + 2 / HOT rows reach the driver."""
    counts = cut(token_counts(docs.select("doc_id", "text")))
    known = counts.where("second is null")
    total, types = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    often = known.where(F.col("n") > COMMON * total).select("token", "n").toArrow()
    hot = counts.where((F.col("second").isNotNull()) & (F.col("n") >= HOT / 2 * total)).select("token", "second").toArrow()
    texts = known.where(F.col("token") == END - (END >> 63 << 64)).select("n").first()
    n = often.column("n").to_numpy()
    order = np.argsort(-n, kind="stable")
    digests = often.column("token").to_numpy().view(np.uint64)[order]
    pairs = np.stack([hot.column(c).to_numpy().view(np.uint64) for c in ("token", "second")], axis=1)
    shards = max(1, round(total * FOLDS / (FOLDS - 1) / shard))
    return Common(digests, n[order], pairs, total, types, texts["n"] if texts else 0, shards)


def score(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    common = learn(docs, SHARD)
    rows = packed(docs, common).repartitionById(common.partitions, "partition").drop("partition")
    names = ("texts", "sums", "rare", "known", "base", "n_tokens", "held")
    fields = pa.schema([("slice", pa.int64()), ("ids", pa.list_(to_arrow_type(docs.schema["doc_id"].dataType))), *[(f, pa.binary()) for f in names]])

    def run(batches):
        for r in _partition_scores((r for b in batches for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist()), common):
            yield pa.RecordBatch.from_pylist([{f: r.get(f) for f in fields.names}], schema=fields)

    parts = rows.mapInArrow(run, f"slice bigint, ids array<{kind}>, {', '.join(f'{f} binary' for f in names)}")
    sums = parts.groupBy("slice").applyInArrow(lambda t: _slice_sums(t, common), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(common.total).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
