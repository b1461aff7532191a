"""Operator 8: SentencePiece encoding by forward filtering and backward sampling, and decoding.

A text is cut where no piece can cross: before each run of spaces and around newlines. The lattice of
such a unit has a node per code point and an arc per piece; forward filtering sums the weights of all
segmentations that reach a node, backward sampling walks from the end and draws each piece in proportion
to them, so a segmentation is drawn in proportion to its weight (up to single precision and draws of 24 bits). All distinct units of a slice are
filtered together, level by level: units are sorted by length, so the nodes of a level are one
contiguous run and every step is one array operation. Random numbers are a counter-based hash of the
row's key, the unit's place and the step: the same row always gets the same segmentation, on any cluster.
A long unit is cut further at its natural ends: places that no piece crosses. All its segmentations pass through them, so
its parts are drawn alone without any change of the distribution.

The model file has BPE pieces, whose scores are ranks; a piece's weight is Zipf's 1 / (rank + shift),
raised to the power ``theta``. Code points without a piece become byte pieces. A literal U+2581 goes by
bytes too, so that decoding returns every text exactly.

Defined results: null text is empty and has no pieces; rows that repeat a key and text get the same
pieces; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession

from folia.llm.common import map_slices, numbered, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
THETA = 1.0
SHIFT = 100.0
LONG = 32  # code points from which a unit is looked through for natural ends
SPACE = "▁"

_UNIT = re.compile(r" *[^ \n]+| +|\n")


class Pieces:
    """The model's pieces as a trie in sorted arrays, with log weights."""

    def __init__(self, path: str, theta: float):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.text = [b""] * size
        self.byte = np.zeros(256, np.int32)
        keep: dict[str, int] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.text[i] = piece.replace(SPACE, " ").encode()
                keep[piece.replace(SPACE, " ")] = i
        rank = np.arange(size) + SHIFT
        self.weight = np.append(-theta * np.log(rank), -np.inf).astype(np.float32)
        self.byte_weight = float(-theta * np.log(size + SHIFT))
        self.longest = max(map(len, keep))
        states = {"": 0}
        for piece in keep:
            for k in range(1, len(piece) + 1):
                states.setdefault(piece[:k], len(states))
        edges = sorted((states[p[:-1]] << 21 | ord(p[-1]), s, keep.get(p, -1)) for p, s in states.items() if p)
        self.key = np.array([e[0] for e in edges], np.int64)
        self.next = np.array([e[1] for e in edges], np.int64)
        self.piece = np.array([e[2] for e in edges], np.int32)
        # Starts are looked up directly: most lattice arcs begin with a code point below 0x250.
        self.low = np.full((len(states), 0x80), -1, np.int32)
        for place, k in enumerate(self.key):
            if (c := int(k) & 0x1FFFFF) < 0x80:
                self.low[int(k) >> 21, c] = place

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Places of the edges (state, char), -1 where the trie has none."""
        out = np.full(len(state), -1, np.int64)
        small = char < 0x80
        out[small] = self.low[state[small], char[small]]
        large = np.flatnonzero(~small)
        if len(large):
            key = state[large] << 21 | char[large]
            place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            out[large] = np.where(self.key[place] == key, place, -1)
        return out


@lru_cache(maxsize=2)
def load(path: str = MODEL, theta: float = THETA) -> Pieces:
    return Pieces(path, theta)


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 output of counters."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lattice(units: list[str], pieces: Pieces):
    """Of units sorted by length, longest first: level offsets, cumulative choice probabilities and piece of each arc into each node.

    Node (e, j), unit j after e code points, is off[e] + j. Arc L of a node is the piece of L code points that ends there.
    """
    lengths = np.array([len(u) for u in units])
    top = int(lengths[0])
    count = [int(np.searchsorted(-lengths, -e, side="right")) for e in range(top + 1)]  # units of at least e code points
    off = np.concatenate([[0], np.cumsum(count)])
    flat = np.frombuffer("".join(units).encode("utf-32-le"), "<u4").astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    chars = [flat[starts[: count[e + 1]] + e] for e in range(top)]
    found, longest = [], 1
    for s in range(top):
        live = np.arange(count[s + 1])
        state = np.zeros(len(live), np.int64)
        for size in range(1, min(pieces.longest, top - s) + 1):
            if size > 1:
                inside = int(np.searchsorted(live, count[s + size]))  # live is sorted, long units come first
                live, state = live[:inside], state[:inside]
            edge = pieces.step(state, chars[s + size - 1][live])
            ok = edge >= 0
            live, edge = live[ok], edge[ok]
            if not len(live):
                break
            got = pieces.piece[edge]
            if (got >= 0).any():
                found.append((off[s + size] + live, size, got))
                longest = max(longest, size)
            state = pieces.next[edge]
    ids = np.full((off[-1], longest), -1, np.int32)  # by end node
    for node, size, got in found:
        ids[node, size - 1] = got
    del found
    weight = pieces.weight[ids]  # -1 picks the last entry, which is -inf
    none = ids[:, 0] < 0  # no piece for this code point alone: its bytes
    for e in range(1, top + 1):
        part = np.flatnonzero(none[off[e] : off[e] + count[e]])
        if len(part):
            c = chars[e - 1][part]
            n_bytes = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
            weight[off[e] + part, 0] = pieces.byte_weight * n_bytes
            ids[off[e] + part, 0] = -2 - c
    alpha = np.zeros(off[-1], np.float32)
    for e in range(1, top + 1):
        n, at = count[e], off[e]
        for size in range(1, min(longest, e) + 1):
            back = off[e - size]
            weight[at : at + n, size - 1] += alpha[back : back + n]
        row = weight[at : at + n]
        high = row.max(axis=1)
        np.subtract(row, high[:, None], out=row)
        np.exp(row, out=row)
        np.cumsum(row, axis=1, out=row)
        alpha[at : at + n] = high + np.log(row[:, -1])
    return off, weight, ids, lengths


def _natural_parts(unit: str, pieces: Pieces) -> list[str]:
    """A unit cut at the places that no piece crosses."""
    chars = np.frombuffer(unit.encode("utf-32-le"), "<u4").astype(np.int64)
    n = len(chars)
    reach = np.arange(1, n + 1)  # where the longest piece from each place ends; a code point is a piece or goes by bytes
    live, state = np.arange(n), np.zeros(n, np.int64)
    for size in range(1, pieces.longest + 1):
        inside = live + size <= n
        live, state = live[inside], state[inside]
        edge = pieces.step(state, chars[live + size - 1])
        live, edge = live[edge >= 0], edge[edge >= 0]
        if not len(live):
            break
        whole = pieces.piece[edge] >= 0
        reach[live[whole]] = live[whole] + size
        state = pieces.next[edge]
    ends = np.flatnonzero(np.maximum.accumulate(reach) == np.arange(1, n + 1)) + 1
    return [unit[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def units_of(text: str, pieces: Pieces) -> list[str]:
    if not text:
        return []
    found = _UNIT.findall(" " + text)
    if max(map(len, found)) <= LONG:
        return found
    return [part for u in found for part in (_natural_parts(u, pieces) if len(u) > LONG else (u,))]


def encode_rows(keys: list[str], texts: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all rows in one array, and each row's number of ids."""
    cut = [units_of(t, pieces) for t in texts]
    counts = np.array([len(u) for u in cut], np.int64)
    if not counts.sum():
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    codes, units = numbered([u for row in cut for u in row])
    del cut
    by_length = sorted(range(len(units)), key=lambda k: -len(units[k]))
    off, cum, ids, lengths = _lattice([units[k] for k in by_length], pieces)
    place = np.empty(len(units), np.int64)
    place[by_length] = np.arange(len(units))
    unit = place[codes]
    seed = np.repeat(_mix(np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)), counts)
    # A unit takes at most as many draws as it has code points: counters are places in the row's text.
    places = np.cumsum(lengths[unit]) - lengths[unit]
    first = np.repeat(np.append(places, 0)[np.cumsum(counts) - counts], counts)
    counter = seed + (places - first).astype(np.uint64)
    where, end = np.arange(len(unit)), lengths[unit]
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    while len(where):
        node = off[end] + unit[where]
        row = cum[node]
        draw = (_mix(counter[where] + np.uint64(len(steps))) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24) * row[:, -1]
        size = (row <= draw[:, None]).sum(axis=1)
        steps.append((where, ids[node, size]))
        end = end - size - 1
        more = end > 0
        where, end = where[more], end[more]
    drawn = np.zeros(len(unit), np.int64)
    byte_len = np.zeros(len(unit), np.int64)
    for where, got in steps:
        c = -2 - got.astype(np.int64)
        byte_len[where] += np.where(c >= 0, (c >= 0x80) + 0 + (c >= 0x800) + (c >= 0x10000), 0)
        drawn[where] += 1
    total = drawn + byte_len
    ends = np.cumsum(total)
    out = np.empty(int(ends[-1]), np.int32)
    cursor = ends.copy()
    for where, got in steps:
        c = -2 - got.astype(np.int64)
        plain = c < 0
        cursor[where[plain]] -= 1
        out[cursor[where[plain]]] = got[plain]
        for w, code in zip(where[~plain].tolist(), c[~plain].tolist(), strict=True):
            raw = pieces.byte[list(chr(code).encode())]
            cursor[w] -= len(raw)
            out[cursor[w] : cursor[w] + len(raw)] = raw
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    return out, np.diff(bounds)


def decode(ids: list[int], pieces: Pieces) -> str:
    """The text of piece ids; the space that encoding put in front goes."""
    text = pieces.text
    return b"".join([text[i] for i in ids])[1:].decode()


def _encode(batch: pa.RecordBatch, path: str, theta: float) -> dict:
    pieces = load(path, theta)
    keys = [str(k) for k in batch.column("key").to_pylist()]
    texts = [t or "" for t in batch.column("text").to_pylist()]
    ids, counts = encode_rows(keys, texts, pieces)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    flat = ids.tolist()
    ok = [decode(flat[a:b], pieces) == t for a, b, t in zip(offsets[:-1].tolist(), offsets[1:].tolist(), texts, strict=True)]
    return {"key": batch.column("key"), "n_pieces": counts, "pieces": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)), "lossless": ok}


def encode(docs: DataFrame, key: str = "doc_id", path: str = MODEL, theta: float = THETA) -> DataFrame:
    """key, n_pieces, pieces array<int>, lossless (decoding gave the text back) for every row of docs (key, text)."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_pieces long, pieces array<int>, lossless boolean"
    out = map_slices(docs.selectExpr(f"`{key}` as key", "text"), "text", lambda b: _encode(b, path, theta), schema, 2_000_000)
    return out.withColumnRenamed("key", key)


def decode_pieces(encoded: DataFrame, key: str = "doc_id", path: str = MODEL) -> DataFrame:
    """key and text of encoded rows (key, pieces)."""

    def run(batches):
        pieces = load(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([decode(x or [], pieces) for x in b.column("pieces").to_pylist()], pa.string())], names=["key", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.selectExpr(f"`{key}` as key", "pieces").mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: the pieces of every document that is left."""
    return encode(docs)
