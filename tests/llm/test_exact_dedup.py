"""Operator 12 against plain Python: odd rows, hot keys, whole rows that stay."""

import hashlib
import re
from collections import defaultdict

import pytest

from folia.llm import exact_dedup

ROWS = [
    (7, "a b\tc", "x"), (3, "abc", "y"), (5, "a  b c ", "z"), (5, "a  b c ", "z"), (None, "a  b c ", "n"), (1, None, "e"), (2, "", "e"), (4, " \n\x0b\x0c\r", "e"), (None, None, "e"),
    (8, "a bc", "nbsp stays"), (9, "é" * 30_000, "long"), (10, " " + "é" * 30_000, "long"), (11, "same head " * 40 + "1", "h"), (12, "same head " * 40 + "2", "h"),
] + [(100 + k, "hot text" + " " * (k % 3), "copies") for k in range(400)]


def plain(rows):
    runs = defaultdict(list)
    for doc_id, text, _ in rows:
        runs[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for key, members in runs.items():
        members.sort(key=lambda m: m[:3])
        digest = hashlib.sha256(key.encode()).hexdigest()
        out += [(m[3], members[0][3], len(members), k == 0, digest) for k, m in enumerate(members)]
    return sorted(out, key=str)


@pytest.mark.parametrize("hot_bytes", [100, 5_000, 1 << 26])
def test_runs_of_equal_texts(spark, hot_bytes):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, hash string").repartition(5)
    found = exact_dedup.classes(docs, hot_bytes).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, found), key=str) == plain(ROWS)


@pytest.mark.parametrize("hot_bytes", [100, 1 << 26])
def test_unique_keeps_whole_rows(spark, hot_bytes):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, hash string")
    kept = exact_dedup.unique(docs, hot_bytes)
    assert kept.columns == docs.columns
    heads = sorted((r[0] for r in plain(ROWS) if r[3]), key=str)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == heads
    assert {tuple(r) for r in kept.collect()} <= set(ROWS)


def test_no_shuffle_but_the_ranges(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    ranked = exact_dedup._ranked(docs.selectExpr("doc_id", "n_chars", "substring(text, 1, 9) as head", "xxhash64(text) as hash", "text as key", "n_chars as n"), ["head", "hash"], 4)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == plan.count("Exchange") == 1
