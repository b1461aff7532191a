"""Operator 6: SimHash near-duplicates by a segment-popcount embedding.

A text's fingerprint sums the bits of the XXH64 of its 4-word shingles. Two fingerprints link at 4 or
fewer differing bits. A fingerprint is embedded as the bit counts of its 32 segments of 2 bits; flipping
a bit moves one count by one, so the Manhattan distance of two embeddings is a lower bound of their
Hamming distance. The range join under that bound runs on a grid of unit cells: the 32 coordinates form
8 blocks of 4; vectors at distance 4 or less agree in at least 4 blocks, so they share the cell of at
least one choice of 4 blocks (70 choices, each a key). What shares a cell passes the bound on all
coordinates and then the exact distance. No link is missed.

Only distinct fingerprints are joined, so exact copies cost one row. Inside a cell, each member is
compared with the cell's first and its previous member; components of these links are labelled, and all
pairs are compared only in cells that still hold several components (a group of many near copies is one
component by then). Of those, cells of more than ``FULL`` members are first split by halving their segments to
single bits, so that unrelated prints do not fill cells as the corpus grows (``pairs_across``). Result: the fingerprint's class and component for every document.

Defined results: null text counts as empty; texts without words have fingerprint zero and link like any
other; a null doc_id takes part, and is never the smallest id; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm.common import cut, map_slices, row_key, table, texts_of, written
from folia.llm.graph import connected_components

SHINGLE = 4
DISTANCE = 4
BLOCKS = 8
FULL = 32  # members of a cell above which it is split by single bits
SALTS = 8


def fingerprint_of(words: list[bytes], size: int = SHINGLE) -> int:
    """Plain form of one text's fingerprint, unsigned."""
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + size]), 42) for k in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _fingerprints(texts: list[bytes], size: int) -> np.ndarray:
    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    for text in texts:
        w = text.lower().split()  # bytes: ASCII letters, ASCII white space
        n = max(1, len(w) - size + 1) if w else 0
        counts.append(n)
        if n == 1:
            hashes.append(digest(b" ".join(w), 42))
        elif n:
            hashes += [digest(b" ".join(s), 42) for s in zip(*[w[k:] for k in range(size)], strict=False)]
    counts = np.array(counts, np.int64)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        h = np.array(hashes, "<u8")
        starts = np.cumsum(counts[full]) - counts[full]
        bits = np.empty((len(full), 64), np.uint8)
        for b in range(64):
            ones = np.add.reduceat((h >> np.uint64(b)) & np.uint64(1), starts)
            bits[:, b] = 2 * ones > counts[full].astype(np.uint64)
        out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out.view(np.int64)


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, key and fp (the 64 bits of the fingerprint as a long) for every row of docs (doc_id, text); key is a hash of both."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", row_key("doc_id", "text").alias("key"), "text")

    def make(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "key": batch.column("key"), "fp": _fingerprints(texts_of(batch), size)}

    return map_slices(rows, "text", make, f"doc_id {kind}, key long, fp long")


def _embedding(fp: Column) -> Column:
    """The 32 segment bit counts in unary at 2 bits each (0: 00, 1: 01, 2: 11), so that their Manhattan distance is a bit count."""
    a, b = fp.bitwiseAND(F.lit(0x5555555555555555)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(0x5555555555555555))
    return a.bitwiseOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def _masks() -> list[int]:
    """For each choice of 4 of the 8 blocks, the bits of its coordinates, as signed longs."""
    whole = [sum(255 << 8 * k for k in chosen) for chosen in combinations(range(BLOCKS), BLOCKS - DISTANCE)]
    return [m - (m >> 63 << 64) for m in whole]


def _near(a: Column, b: Column) -> Column:
    """Manhattan distance of the embeddings, the lower bound, then the exact Hamming distance."""
    bound = F.bit_count(_embedding(a).bitwiseXOR(_embedding(b)))
    return (bound <= DISTANCE) & (F.bit_count(a.bitwiseXOR(b)) <= DISTANCE)


def _masked(fp: Column, choice: Column) -> Column:
    return fp.bitwiseAND(F.get(F.lit(_masks()), choice))


def pairs_across(rows: DataFrame) -> DataFrame:
    """Of rows (cell, n, fp, label), n the cell's size: every pair (a, la, b, lb) of members with different labels, la < lb, that is to be compared.

    Cells of more than ``FULL`` members are split: their segments are halved to single bits. A link of up to 4 bits changes
    at most 4 of the 8 blocks, so there is a choice of 4 blocks in which both prints agree bit by bit, not in bit counts
    alone: nothing is lost, and unrelated prints share such a cell with chance 2^-32 instead of (3/8)^16.
    """
    bits = F.when(F.col("n") > FULL, _masked(F.col("fp"), F.col("cell.choice"))).otherwise(F.lit(0))
    rows = rows.select("cell", bits.alias("bits"), "fp", "label")
    mixed = rows.groupBy("cell", "bits").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    rows = cut(rows.join(mixed.select("cell", "bits"), ["cell", "bits"], "left_semi"))
    a = rows.select("cell", "bits", F.col("fp").alias("a"), F.col("label").alias("la"))
    b = rows.select("cell", "bits", F.col("fp").alias("b"), F.col("label").alias("lb"))
    return a.join(b, ["cell", "bits"]).where(F.col("la") < F.col("lb")).select("a", "la", "b", "lb")


def components(prints: DataFrame) -> DataFrame:
    """Of distinct fingerprints (fp): (node, label) for those with a link to another, label the least fp of the component."""
    members = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(_masks()) - 1))).alias("choice"))
    members = members.select("fp", "choice", _masked(_embedding(F.col("fp")), F.col("choice")).alias("at"))
    cell = "partition by choice, at order by fp"
    seen = members.select(F.struct("choice", "at").alias("cell"), "fp", F.expr(f"lag(fp) over ({cell})").alias("previous"),
        F.expr(f"first(fp) over ({cell})").alias("first"), F.expr(f"row_number() over ({cell})").alias("place"))
    seen = cut(seen.where(F.col("place") > 1))
    pairs = seen.select("fp", F.explode(F.array_distinct(F.array("previous", "first"))).alias("other"))
    edges = pairs.where(_near(F.col("fp"), F.col("other"))).select(F.col("fp").alias("u"), F.col("other").alias("v")).distinct()
    labels = connected_components(edges)
    # In cells of up to three members the pairs above are all pairs. Larger ones are looked at again if they hold several components.
    large = seen.groupBy("cell").agg(F.max("place").alias("n"), F.first("first").alias("first")).where("n > 3")
    rows = seen.select("cell", "fp").join(large.select("cell", "n"), "cell").unionByName(large.select("cell", "n", F.col("first").alias("fp")))
    rows = rows.join(labels, rows["fp"] == labels["node"], "left").select("cell", "n", "fp", F.coalesce("label", "fp").alias("label"))
    across = pairs_across(rows).where(_near(F.col("a"), F.col("b")))
    merged = connected_components(across.select(F.col("la").alias("u"), F.col("lb").alias("v")).distinct())
    # A label that only the second pass links is a fingerprint that the first pass left alone.
    nodes = labels.unionByName(merged.select("node", F.col("node").alias("label")).join(labels.select("node"), "node", "left_anti"))
    merged = merged.withColumnsRenamed({"node": "old", "label": "new"})
    return nodes.join(merged, nodes["label"] == merged["old"], "left").select("node", F.coalesce("new", "label").alias("label"))


def first_of_components(rows: DataFrame, first: Column) -> DataFrame:
    """Of rows with a fingerprint fp: one row (fp, first) per distinct fp, with the least ``first`` of its component.

    Only linked fingerprints are joined by their label; a label of very many fingerprints is spread over ``SALTS`` keys.
    """
    classes = cut(rows.groupBy("fp").agg(F.min(first).alias("least")))
    linked = components(classes.select("fp"))
    labelled = classes.join(linked, classes["fp"] == linked["node"], "left").select("fp", "least", "label")
    labelled = cut(labelled.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")))
    part = labelled.where("label is not null")
    least = part.groupBy("label", "salt").agg(F.min("least").alias("first")).groupBy("label").agg(F.min("first").alias("first"))
    least = least.select("label", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    alone = labelled.where("label is null").select("fp", F.col("least").alias("first"))
    return alone.unionByName(part.join(least, ["label", "salt"]).select("fp", "first"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id of the component) for every row of docs (doc_id, text)."""
    rows = cut(fingerprints(docs, size))
    return rows.join(first_of_components(rows, F.col("doc_id")), "fp").select("doc_id", "fp", F.col("first").alias("component_id"))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: that of the smallest doc_id, null last; among rows of one doc_id, that of the least hash of id and text.

    Only keys are shuffled: documents meet the written table of the keys that go, which Spark broadcasts while it is small.
    Rows that repeat both id and text share a key; one of them stays.
    """
    rows = cut(fingerprints(docs))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    firsts = first_of_components(rows, order)
    judged = rows.join(firsts, "fp").groupBy("key").agg(F.first(F.col("key") == F.col("first.key")).alias("stays"), F.count("*").alias("n"))
    judged = cut(judged.where(~F.col("stays") | (F.col("n") > 1)))
    go, again = written(judged.where(~F.col("stays")).select("key")), written(judged.where("stays").select("key"))
    keyed = docs.select(F.struct("*").alias("row"), row_key("doc_id", "text").alias("key"))
    kept = keyed.join(go, "key", "left_anti")
    if again.isEmpty():
        return kept.select("row.*")
    once = kept.join(again, "key", "left_anti")
    repeats = kept.join(again, "key", "left_semi").groupBy("key").agg(F.first("row").alias("row"))
    return once.select("row.*").unionByName(repeats.select("row.*"))
