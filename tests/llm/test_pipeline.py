"""The pipeline's rows against the stages in plain Python that shares nothing with the operators but the hash and the pieces."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np

import corpus_pipeline
from folia.llm import sampled_pieces, simhash

BLANKS = "[\\x20\\x09-\\x0D]+"


def grams(words, n):
    return [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]


def quality_kept(text):
    """The base rules, then repeats of eight words or more: at most 30 % of the words in them, none longer than a quarter."""
    words = [w for w in re.split(BLANKS, text) if w]
    n = len(words)

    def covered(size):
        many = {g for g, c in Counter(grams(words, size)).items() if c > 1}
        return len({k + i for k, g in enumerate(grams(words, size)) if g in many for i in range(size)})

    if n < 50 or 100 * covered(3) > 50 * n:
        return False
    low, high = 0, n  # the longest repeat: repeats of one length have repeats of every shorter one
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if len(set(grams(words, mid))) < n - mid + 1 else (low, mid - 1)
    return covered(8) <= 0.3 * n and (low < 8 or low <= 0.25 * n)


def without_boilerplate(rows):
    """rows (id, host, text) with lines on over 2 % of the host's distinct texts, two at least, taken out."""
    texts, holds = defaultdict(set), defaultdict(set)
    for _, host, text in rows:
        texts[host].add(text)
        for line in text.split("\n"):
            if re.search("[^\\x20\\x09-\\x0D]", line):
                holds[host, line].add(text)
    bad = {key for key, which in holds.items() if len(which) > 1 and len(which) > 0.02 * len(texts[key[0]])}
    return {i: "\n".join(x for x in text.split("\n") if (host, x) not in bad) for i, host, text in rows}


def leaks(text, items):
    """Whether an item lies in the text with at most a fifth of its words edited: the whole table of edit distances, row by row."""
    words = lambda t: re.findall("[0-9a-z\\x80-\\U0010ffff]+", t.lower() if t.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), t))
    there = np.array(words(text), object)
    for item in items:
        asked = words(item)
        if not asked:
            continue
        steps = np.arange(len(there) + 1)
        row = np.zeros(len(there) + 1, int)
        for k, w in enumerate(asked):
            best = np.append(k + 1, np.minimum(row[:-1] + (there != w), row[1:] + 1))
            row = np.minimum.accumulate(best - steps) + steps
        if row.min() <= int(0.2 * len(asked)):
            return True
    return False


def test_run(spark, small):
    from tests.llm.test_contracts import components

    got = corpus_pipeline.run(spark, small)
    rows = {r.doc_id: r for r in got.collect()}
    docs = duckdb.sql(f"select doc_id, source, coalesce(text, '') from '{small}/documents.parquet'").fetchall()
    judged = [r for r in docs if quality_kept(r[2])]
    texts = without_boilerplate(judged)
    prints = {i: simhash.fingerprint_of(re.sub("[A-Z]", lambda m: m[0].lower(), t).encode().split()) for i, t in texts.items()}
    stay = {i for i, c in components(prints).items() if i == c}
    items = [t or "" for (t,) in duckdb.sql(f"select text from '{small}/benchmark.parquet'").fetchall()]
    clean = {i for i in stay if not leaks(texts[i], items)}
    assert set(rows) == clean and 50 < len(clean) < len(stay) < len(judged) < len(docs)
    pieces = sampled_pieces.load()
    assert all(r.lossless and sampled_pieces.decode(r.pieces, pieces) == texts[i] for i, r in rows.items())


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(50), small).columns == docs.columns, name


def test_stages_take_odd_and_empty_tables(spark, small):
    from tests.llm.test_contracts import ODD

    docs = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string").selectExpr("*", "cast(length(text) as bigint) as n_chars")
    clashing = ("key", "fp", "row", "leaks", "whole", "n_lines", "n_dropped", "drop", "site", "here", "kept", "stays", "first", "label", "n_words",
        "base_failed", "pieces", "lossless")
    docs = docs.selectExpr("*", *[f"{k} as {c}" for k, c in enumerate(clashing)])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() <= len(ODD), name
        assert stage(spark, docs.limit(0), small).count() == 0, name
