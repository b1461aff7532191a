"""The queries with SQL against DuckDB, the others against plain Python, on small given tables and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folia.llm import decontaminate, html_text, license_scan, line_dedup, ngram_score, personal_data, registry, repetition, sampled_pieces, sharding, simhash
from tests.sql import assert_same

ODD = [
    (1, "", "en", "a"), (2, None, None, None), (None, "a b c d e f " * 20, "en", "a"), (None, None, "en", "a"), (3, "x" * 5000, "en", "a"), (4, "same text here " * 30, "en", "b"),
    (4, "same text here " * 30, "en", "b"), (5, "same text here " * 30, "en", "b"), (6, "\n\n \t\n", "en", "b"),
        (7, "Released under the MIT License.\nmail a@b.cd +1 (743) 555-3824", "en", "b"),
    (8, " ".join(f"w{k}" for k in range(3000)), "de", "c"), (9, "\u0000 ▁ é \U0001f600 ï", "fr", "c"),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    # Columns of the operators' own names must not get in the way.
    docs = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.withColumns({c: F.lit(1) for c in ("key", "fp", "shard", "n_words", "score", "label", "pieces", "kept", "site", "row", "leaks")})
    docs.write.parquet(f"{folder}/documents.parquet")
    docs.limit(0).write.parquet(f"{folder}/empty/documents.parquet")
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>x"), (3, "u", "<article><p>a&amp;b \n c<br>d</article>"),
        (3, "u", "<" * 2000)], "page_id bigint, url string, html string")
    pages.write.parquet(f"{folder}/pages.parquet")
    pages.limit(0).write.parquet(f"{folder}/empty/pages.parquet")
    bench = spark.createDataFrame([(1, None), (None, "a b c d e f a b c d e f"), (2, "short one"), (3, " ".join(f"w{k}" for k in range(100, 130)))], "item_id bigint, text string")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    bench.limit(0).write.parquet(f"{folder}/empty/benchmark.parquet")
    vectors = spark.createDataFrame([(k, [float(k)] * 64 if k else None) for k, _ in enumerate(ODD)] + [(None, [0.5] * 64)], "vec_id bigint, embedding array<float>")
    vectors.write.parquet(f"{folder}/embeddings.parquet")
    vectors.limit(0).write.parquet(f"{folder}/empty/embeddings.parquet")
    turns = [(k, t, role, text) for k in (*range(len(ODD) - 1), None) for t, role, text in ((None, None, None), (1, "user", "a b."), (1, "user", "a b."), (2, "", ""), (9, "tool", "x" * 5000))]
    turns = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit(1) for c in ("kind", "copy", "last", "n", "digest")})
    turns.write.parquet(f"{folder}/conversations.parquet")
    turns.limit(0).write.parquet(f"{folder}/empty/conversations.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, small, name):
    assert_same(registry.QUERIES[name](spark, small), registry.SQL[name], small)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_odd_and_empty_tables(spark, odd, name):
    rows = registry.QUERIES[name](spark, odd).collect()
    if name == "op9_html_text":
        assert len(rows) == 5
    elif name != "op2_decontaminate":
        assert len(rows) == len(ODD)
    assert registry.QUERIES[name](spark, f"{odd}/empty").collect() == []


def documents(small):
    return duckdb.sql(f"select doc_id, text, source from '{small}/documents.parquet'").fetchall()


def components(prints, distance=4):
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_simhash_components(spark, small):
    rows = {r.doc_id: r for r in simhash.query(spark, small).collect()}
    prints = {i: simhash.fingerprint_of(t.encode().lower().split()) for i, t, _ in documents(small)}
    assert {i: r.fingerprint for i, r in rows.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in rows.items()} == components(prints)


@pytest.mark.parametrize("seed", [1, 2])
def test_links_between_many_near_prints(spark, seed):
    rng = random.Random(seed)
    prints = []
    for _ in range(6):  # clouds around a centre: cells with many members, some of them in several components
        centre = rng.getrandbits(64)
        for _ in range(60):
            p = centre
            for b in rng.sample(range(64), rng.choice((1, 3, 5, 6))):
                p ^= 1 << b
            prints.append(p)
    prints = sorted({p - (p >> 63 << 64) for p in prints})
    df = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    got = {r.node: r.label for r in simhash.components(df).collect()}
    truth = components({p: p & (1 << 64) - 1 for p in prints})
    classes = defaultdict(set)
    for p, c in truth.items():
        classes[c].add(p)
    assert {frozenset(c) for c in classes.values() if len(c) > 1} == {frozenset(p for p in got if got[p] == label) for label in set(got.values())}


def brute_repeats(w):
    out = [0] * len(w)
    for i in range(len(w)):
        for j in range(len(w)):
            k = 0
            while i != j and i + k < len(w) and j + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            out[i] = max(out[i], k if k >= 3 else 0)
    return out


def test_longest_repeats():
    rng = random.Random(5)
    for _ in range(120):
        docs = []
        for _ in range(rng.randint(1, 4)):
            w = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 30))]
            docs.append(w + w[: rng.randint(0, len(w))])
        ids, counts = repetition.word_ids([" ".join(w).encode() for w in docs])
        assert repetition.longest_repeats(ids, counts).tolist() == [x for w in docs for x in brute_repeats(w)]


def quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    three = Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {k + d for k in range(len(w) - 2) if three[w[k], w[k + 1], w[k + 2]] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def test_quality_measures(spark, small):
    rows = {r.doc_id: r for r in repetition.query(spark, small).collect()}
    for i, text, _ in documents(small):
        r = rows[i]
        q = quality(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == q
        assert r.base_failed == (q[0] < 50 or 100 * q[4] > 50 * q[0]) and not (r.kept and r.base_failed)


def test_quality_verdict(spark, small):
    """Covered words, longest repeat and verdict against enumeration, on texts with repeats of all lengths."""
    rng = random.Random(12)
    texts = [" ".join(t.split()[:150]) for _, t, _ in documents(small)[:60]]
    for _ in range(60):
        w = [f"w{rng.randrange(90)}" for _ in range(rng.randint(40, 90))]
        for _ in range(rng.randint(0, 3)):
            at, n = rng.randrange(len(w)), rng.randint(2, 25)
            w[rng.randrange(len(w)) : 0] = w[at : at + n]
        texts.append(" ".join(w))
    rows = {r.doc_id: r for r in repetition.judge(repetition.repetition(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))).collect()}
    for k, text in enumerate(texts):
        w = text.split()
        long = [(i, n) for i, n in enumerate(brute_repeats(w)) if n >= repetition.MIN_REPEAT]
        covered, longest = len({i + d for i, n in long for d in range(n)}), max((n for _, n in long), default=0)
        r = rows[k]
        assert (r.n_covered, r.longest_repeat) == (covered, longest)
        assert r.kept == (not r.base_failed and covered <= repetition.MAX_COVERED * len(w) and longest <= repetition.MAX_LONGEST * len(w))
    assert len({r.kept for r in rows.values()}) == 2


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else False,
                "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns(small):
    rng = random.Random(4)
    texts = [t for _, t, _ in documents(small)]
    texts += ["".join(rng.choice("a1.@_-+ ()%9é2") for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "1.2.3.4567.1.1.1", "4532 0151-1283 0366", "+1 (743) 555-3824.", "a@b.c@d.e"]
    for t in texts:
        assert personal_data.base_spans(t) == plain_spans(t), t


def test_patterns_find_unseen_identifiers(spark):
    rows = [(k, f"please note customer code: u{k}@site.example and more") for k in range(6)]
    rows += [(9, "please note customer code: ZX-99812-Q and more"), (10, "version ABC-12345 of it")]
    out = {r.doc_id: r.spans for r in personal_data.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out[9] == "id:27:37" and out[10] == "" and out[0].startswith("email:27:")


def test_tokens_are_found_and_chance_contexts_are_not(spark):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("la", "mo", "ri", "tu", "se") for b in ("na", "po", "ki", "ve", "do")]
    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(12)]
    rows = [(k, f'{rng.choice(words)} {rng.choice(words)} token = "{key}" {rng.choice(words)} {rng.choice(words)}') for k, key in enumerate(keys)]
    rows += [(20, 'lana token = "abc-123456" mopo')]  # not opaque: known by its context alone
    rows += [(30 + k, f"u{k}@site.example starts a text") for k in range(8)] + [(40, "8294846167456848 starts a text too")]
    rows += [(50 + k, f"as the of v{k}@site.example is") for k in range(8)] + [(60, "as the of 8294846167456848 is")] + [(61 + k, f"as the of {w} is") for k, w in enumerate(words)]
    rows += [(90 + k, f"published on 2019-05-1{k} in {w}") for k, w in enumerate(words[:9])]
    out = {r.doc_id: r.spans for r in personal_data.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(out[k] == f"id:{t.index(key)}:{t.index(key) + 40}" for (k, t), key in zip(rows, keys, strict=False))
    assert out[20] == "id:14:24" and out[40] == out[60] == out[90] == ""


def test_context_words_are_found_at_any_distance():
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice(["ab ", "c", "1", "-", ".. ", " " * rng.choice((1, 3, 500)), "x9 ", "\u00e9t\u00e9 "]) for _ in range(rng.randint(0, 30)))
        sides = personal_data.Sides(text)
        for start in range(0, len(text), 7):
            end = min(len(text), start + rng.randint(0, 9))
            left = [m.span() for m in personal_data._WORD.finditer(text[:start])][-2:]
            right = personal_data._WORD.search(text, end)
            assert sides.left(start) == left and sides.right(end) == (right and right.span())


def plain_scores(edges, others):
    score = defaultdict(float)
    for _, _, i, prior in edges:
        score[i] = max(score[i], prior)
    while True:
        total, number, context = Counter(), Counter(), {}
        for p, c, i, _ in edges:
            total[p] += score[i]
            number[p] += 1
            context[p] = c
        confidence = {p: total[p] / (number[p] + others.get(context[p], 0) + 1) for p in number}
        new = defaultdict(float)
        for p, _, i, prior in edges:
            new[i] = max(new[i], prior, confidence[p])
        moved, score = max(abs(new[i] - score[i]) for i in new), new
        if moved <= personal_data.SETTLED:
            return {p: (confidence[p], number[p]) for p in number}


def test_pattern_scores_equal_plain_python(spark):
    rng = random.Random(5)
    edges = sorted({(f"p{p}", f"c{p // 2}", f"i{rng.randrange(60)}") for p in range(25) for _ in range(rng.randint(1, 15))})
    prior = {f"i{k}": rng.choice((0.0, 0.0, 0.9, 1.0)) for k in range(60)}
    edges = [(*e, prior[e[2]]) for e in edges]
    others = {f"c{k}": rng.randint(0, 9) for k in range(6)}
    frames = spark.createDataFrame(edges, "pattern string, context string, instance string, prior double"), spark.createDataFrame(list(others.items()), "context string, others bigint")
    got = {r.pattern: (r.confidence, r.instances) for r in personal_data.pattern_scores(*frames).collect()}
    truth = plain_scores(edges, others)
    assert got.keys() == truth.keys() and all(abs(got[p][0] - c) < 1e-9 and got[p][1] == n for p, (c, n) in truth.items())


def test_spans_equal_plain_python(spark):
    """Whole result on given and planted rows: the graph, its scores and the spans, with contexts counted in blocks; precision and recall of planted secrets."""
    rng = random.Random(9)
    words = [f"{a}{b}" for a in ("la", "mo", "ri", "tu", "se") for b in ("na", "po", "ki", "ve", "do")]
    rows, planted = [], set()
    for k in range(60):
        key = "".join(rng.choice("0123456789abcdefXYZ") for _ in range(rng.choice((24, 40))))
        head = " ".join(rng.choices(words, k=5))
        name = rng.choice(("token = \"", "secret: ", "api key is "))
        rows.append((k, f"{head} {name}{key} {' '.join(rng.choices(words, k=5))}"))
        planted.add((k, len(head) + 1 + len(name), len(head) + 1 + len(name) + len(key)))
    rows += [(100 + k, f"{' '.join(rng.choices(words, k=6))} in {1900 + k}-{10 + k % 3}-{10 + k % 17} {rng.choice(words)} of u{k}@site.example") for k in range(40)]
    found, seen = [], set()
    for i, text in rows:
        seeds = personal_data.base_spans(text)
        for seed, a, b in [(True, x, y) for _, x, y in seeds] + [(False, x, y) for x, y in personal_data.identifiers(text, seeds)]:
            for p, c in personal_data.patterns_of(personal_data.Sides(text), a, b):
                token = text[a:b].lower()
                found.append((i, a, b, seed, p, c, token, 1.0 if seed else personal_data.OPAQUE * personal_data.opaque(text[a:b])))
    prior = defaultdict(float)
    for *_, p, c, token, s in found:
        prior[p, c, token] = max(prior[p, c, token], s)
    edges = [(*e, s) for e, s in prior.items()]
    trusted = lambda scores: {p for p, (c, n) in scores.items() if c >= personal_data.CONFIDENCE and n >= personal_data.INSTANCES}
    possible = trusted(plain_scores(edges, {}))
    contexts = {c for p, c, *_ in edges if p in possible}
    for text in (t for _, t in rows):
        spans = [(a, b) for _, a, b in personal_data.base_spans(text)] + personal_data.identifiers(text, personal_data.base_spans(text))
        for m in re.finditer(r"\w+", text):
            if not any(a < m.end() and m.start() < b for a, b in spans):
                seen |= {(c, m.group().lower()) for c in personal_data.contexts_of(personal_data.Sides(text), *m.span()) if c in contexts}
    others = Counter(c for c, _ in seen)
    number = plain_scores(edges, {})
    most = {c: max(0, math.floor(max(number[p][1] for p, x, *_ in edges if x == c and p in possible) * (1 / personal_data.CONFIDENCE - 1) - 1 + 1e-9)) for c in contexts}
    final = trusted(plain_scores([e for e in edges if e[0] in possible and others[e[1]] <= most[e[1]]], others))
    truth = {(i, a, b) for i, a, b, seed, p, *_ in found if not seed and p in final}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, int(x.split(":")[1]), int(x.split(":")[2])) for r in personal_data.personal_data(docs).collect() for x in r.spans.split(",") if x.startswith("id:")}
    assert got == truth
    assert len(got & planted) >= 0.9 * len(planted) and len(got - planted) <= 0.1 * len(got)
    for bound in (most, dict.fromkeys(contexts, 10**6)):
        counted = personal_data.other_words(docs, spark.createDataFrame(sorted(bound.items()), "context string, most bigint"), block=3).collect()
        assert {r.context: r.others for r in counted if not r.broken} == {c: n for c, n in others.items() if n <= bound[c]}
        assert {r.context for r in counted if r.broken} == {c for c, n in others.items() if n > bound[c]}


def test_personal_data_query(spark, small):
    rows = {r.doc_id: r for r in personal_data.query(spark, small).collect()}
    for i, text, _ in documents(small):
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(text))
        assert rows[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and rows[i].spans.startswith(base)


def test_a_spool_keeps_order_and_holds_little(tmp_path):
    spool, most = ngram_score.Spool(str(tmp_path / "s"), 1000), 0
    for k in range(500):
        spool.add({"k": k, "x": bytes(90)}, 90)
        most = max(most, len(spool.items))
    assert most <= 12 and spool.filed > 480
    for _ in range(2):  # the pieces are read twice
        assert [x["k"] for x in spool] == list(range(500))


@pytest.mark.parametrize(("shard", "partitions", "common", "slice_bytes"), [(40_000, 4096, 1e-4, 50_000), (10_000, 3, 1e-3, 12_000_000), (10**9, 4096, 1e-6, 12_000_000)])
def test_scores(spark, small, monkeypatch, shard, partitions, common, slice_bytes):
    """Whole result against plain Python: many shards and slices, several shards a partition, one shard; hot pairs in all."""
    for name, value in (("SHARD", shard), ("PARTITIONS", partitions), ("COMMON", common), ("SLICE", slice_bytes), ("HOT", 2e-3), ("CHUNK", 20_000)):
        monkeypatch.setattr(ngram_score, name, value)
    docs = documents(small)
    copy_of = next(t for i, t, _ in docs if zlib.crc32(str(i).encode()) % 7 != 2 and len(t) > 1000)
    twice = next(i for i in range(10_000, 20_000) if zlib.crc32(str(i).encode()) % 7 == 2)
    docs.append((twice, copy_of, None))
    rows = {r.doc_id: r for r in ngram_score.score(spark.createDataFrame(docs, "doc_id bigint, text string, source string")).collect()}
    assert len(rows) == len(docs)
    token = {i: t.encode().lower().split() + [b"\n"] for i, t, _ in docs}
    one, two, three = Counter(), Counter(), Counter()
    for i, w in token.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            long = [b"\n", b"\n", *w]
            one.update(w)
            two.update(zip(long[1:], w, strict=False))
            three.update(zip(long, long[1:], w, strict=False))
    total, scale = sum(one.values()), sum(one.values()) + len(one) + 1
    often = {x for x, n in one.items() if n > common * total}
    rest = (scale - sum(one[x] + 1 for x in often)) / scale / (len(one) - len(often) + 1)
    mu2, mu3 = ngram_score.MU2, ngram_score.MU3
    held = base = model = 0
    for i, w in token.items():
        r, s, u, v = rows[i], 0.0, b"\n", b"\n"
        for n, x in enumerate(w):
            p = (two[v, x] + mu2 * ((one[x] + 1) / scale if x in often else rest)) / (one[v] + mu2)
            s += math.log10((three[u, v, x] + mu3 * p) / ((two[u, v] if n else one[b"\n"]) + mu3))
            u, v = v, x
        b = sum(math.log10((one[x] + 1) / scale) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(one[x] > 0 for x in w), total, zlib.crc32(str(i).encode()) % 7 == 2)
        assert abs(r.base_score - b) < 1e-6 and abs(r.score - s) < 1e-3 * len(w), (i, r.score, s)
        if r.held_out and i != twice:
            held, base, model = held + len(w), base + r.base_score, model + r.score
    assert model > base  # the trigram model tells more of texts that it has not seen
    assert rows[twice].score / len(token[twice]) > model / held + 1  # and knows a text of which it has seen a copy


def test_elias_fano(tmp_path, monkeypatch):
    import numpy as np

    monkeypatch.setattr(ngram_score, "CHUNK", 64)
    rng = np.random.default_rng(3)
    for n, top in ((1, 40), (2, 40), (70, 3), (64, 30), (65, 30), (1000, 40), (1000, 62), (300, 1)):
        v = np.sort(rng.integers(0, 1 << top, n)).astype(np.uint64)
        ef = ngram_score.EliasFano(v, str(tmp_path), f"t{n}-{top}")
        assert (ef.get(np.arange(n)) == v).all() and (ef.values(n // 3, n) == v[n // 3 :]).all()
        q = np.concatenate([rng.integers(0, 1 << top, 200).astype(np.uint64), v])
        begin = rng.integers(0, n + 1, len(q))
        end = rng.integers(begin, n + 1)
        at, there = ef.successor(begin, end, q)
        assert at.tolist() == [b + int(np.searchsorted(v[b:e], x)) for b, e, x in zip(begin, end, q, strict=True)]
        first = np.searchsorted(v, q)
        assert there.tolist() == [bool(a < e and v[a] == x and a == f) for a, e, x, f in zip(at, end, q, first, strict=True)]
        assert ef.low.nbytes <= (n * ef.low_bits >> 3) + 24  # low bits are packed


def test_sampled_segmentations():
    pieces = sampled_pieces.load()
    texts = ["", "a", " a  b ", "Hello  world\n\nfoo ▁x é z ｆ \U0001f600", "x" * 200 + " y", "\n", "\0 b c", "thnterble, the of"]
    for keys in (list("abcdefgh"), list("hgfedcba")):
        ids, counts = sampled_pieces.encode_rows(keys, texts, pieces)
        at = 0
        for t, n in zip(texts, counts, strict=True):
            assert sampled_pieces.decode(ids[at : at + n].tolist(), pieces) == t
            at += n
    alone, _ = sampled_pieces.encode_rows(["k"], [texts[3]], pieces)
    among, counts = sampled_pieces.encode_rows(["x", "k"], [texts[7], texts[3]], pieces)
    assert among[counts[0] :].tolist() == alone.tolist()  # a row's pieces depend on nothing but the row

    def ways(w):
        if not w:
            yield (), 0.0
        for k in range(1, len(w) + 1):
            for i in known.get(w[:k], ()):
                for rest, weight in ways(w[k:]):
                    yield (i, *rest), weight + float(pieces.weight[i])

    known = defaultdict(list)
    for i, p in enumerate(pieces.text):
        if p and i >= 259:
            known[p.decode()].append(i)
    chance = {s: math.exp(w) for s, w in ways(" then")}
    total, n = sum(chance.values()), 30_000
    ids, counts = sampled_pieces.encode_rows([str(k) for k in range(n)], ["then"] * n, pieces)
    seen, at = Counter(), 0
    for c in counts:
        seen[tuple(ids[at : at + c].tolist())] += 1
        at += c
    assert set(seen) <= set(chance) and max(abs(seen[s] / n - chance[s] / total) for s in chance) < 0.01


def test_long_units_are_drawn_like_short_ones():
    """Units without spaces: the parts that no piece crosses are drawn alone; their pieces are those of the whole unit's distribution."""
    pieces = sampled_pieces.load()
    text = "thenthen" * 3 + "\u4e2d\u6587" * 40 + "=" * 300 + "then"
    parts = sampled_pieces.units_of(text, pieces)
    assert "".join(parts) == " " + text and len(parts) > 40
    known = {p.decode() for p in pieces.text[3:] if p and not (len(p) == 1 and p[0] > 127)}
    ends = np.cumsum([len(p) for p in parts]).tolist()
    whole = " " + text
    for e in ends[:-1]:  # no piece crosses a cut
        assert not any(whole[a:b] in known for a in range(max(0, e - pieces.longest), e) for b in range(e + 1, min(len(whole), e + pieces.longest)))
    off, cum, ids, lengths = sampled_pieces._lattice([whole], pieces)
    n = 4000
    drawn, counts = sampled_pieces.encode_rows([str(k) for k in range(n)], [text] * n, pieces)
    ends_of = np.cumsum(counts)
    # P(last piece) at the end of the uncut unit is the last row of its lattice.
    row = cum[off[lengths[0]]]
    chance = np.diff(np.append(0, row)) / row[-1]
    seen = Counter(drawn[ends_of - 1].tolist())
    for size, p in enumerate(chance.tolist()):
        if p > 0:
            assert abs(seen[int(ids[off[lengths[0]], size])] / n - p) < 0.04


def test_pieces_are_lossless(spark, small):
    out = sampled_pieces.query(spark, small)
    assert out.where("not lossless").isEmpty()
    texts = {i: t for i, t, _ in documents(small)}
    assert all(texts[r.doc_id] == r.text for r in sampled_pieces.decode_pieces(out).collect())


def test_leaks(spark, small):
    items = duckdb.sql(f"select item_id, text from '{small}/benchmark.parquet'").fetchall()
    words = {i: b" ".join(decontaminate.words_of(t.encode())) for i, t in items}
    exact = {(i, k) for i, t, _ in documents(small) for k, w in words.items() if b" " + w + b" " in b" " + b" ".join(decontaminate.words_of(t.encode())) + b" "}
    found = {(r.doc_id, r.item_id) for r in decontaminate.query(spark, small).where("edits = 0").collect()}
    assert found == exact and exact


@pytest.mark.parametrize(("rate", "least"), [(0.0, 1.0), (0.05, 0.95), (0.1, 0.9)])
def test_recall_of_edited_items(small, rate, least):
    rng = random.Random(8)
    items = [(k, t.encode()) for k, t in duckdb.sql(f"select item_id, text from '{small}/benchmark.parquet'").fetchall()]
    index = decontaminate.Index(items)
    vocabulary = [w for _, t, _ in documents(small)[:60] for w in decontaminate.words_of(t.encode())]
    hits = n = 0
    for _ in range(3):
        for k, t in items:
            w = decontaminate.words_of(t)
            for _ in range(round(rate * len(w))):
                at, what = rng.randrange(len(w)), rng.random()
                w[at : at + 1] = [rng.choice(vocabulary)] if what < 1 / 3 else [] if what < 2 / 3 else [w[at], rng.choice(vocabulary)]
            text = b" ".join(rng.choices(vocabulary, k=80) + w + rng.choices(vocabulary, k=80))
            n, hits = n + 1, hits + any(h[0] == k for h in decontaminate.leaks_in([text], index, decontaminate.MAX_EDITS)[0])
    assert hits / n >= least


@pytest.mark.parametrize("rate", [0.15, 0.2])
def test_every_edited_item_is_found(rate):
    rng = random.Random(8)
    vocabulary = [f"w{k}".encode() for k in range(300)]
    items = [(k, b" ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate([8, 10, 14, 40, 58, 150, 400] * 4)]
    index = decontaminate.Index(items)
    texts = [b""] * 4
    for k, t in items:
        w = t.split()
        for _ in range(int(rate * len(w))):
            at, what = rng.randrange(len(w)), rng.random()
            w[at : at + 1] = [rng.choice(vocabulary)] if what < 1 / 3 else [] if what < 2 / 3 else [w[at], rng.choice(vocabulary)]
        texts += [b" ".join(rng.choices(vocabulary, k=k % 3) + w), b"", b"", b""]
    leaks = decontaminate.leaks_in(texts, index, decontaminate.MAX_EDITS)
    assert all(any(h[0] == k for h in leaks[4 + 4 * k]) for k, _ in items)


def test_leaks_equal_the_best_stretches(spark):
    """Whole result against brute force over every document and item, short items, blocks of few items and repeated items included."""
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, rng.choices(vocabulary, k=n)) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 15, 20, 31])]
    items += [(50, items[9][1]), (51, [])]
    docs = [(0, []), (1, rng.choices(vocabulary, k=200))]
    for k in range(40):
        w = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, len(w) // 4)):
            at = rng.randrange(len(w) or 1)
            w[at : at + 1] = [rng.choice(vocabulary)] if rng.random() < 0.5 else []
        docs.append((10 + k, rng.choices(vocabulary, k=rng.randint(0, 9)) + w + rng.choices(vocabulary, k=rng.randint(0, 9))))
    truth = set()
    for i, text in docs:
        for k, w in items:
            hit = decontaminate.best_stretch(w, text, int(decontaminate.MAX_EDITS * len(w))) if w else None
            if hit:
                truth.add((i, k, hit[1], hit[2], hit[0]))
    frames = [spark.createDataFrame([(i, " ".join(w)) for i, w in rows], f"{c} bigint, text string") for rows, c in ((docs, "doc_id"), (items, "item_id"))]
    for block in (4, 10_000):
        assert {tuple(r) for r in decontaminate.find_leaks(*frames, block=block).collect()} == truth
    assert len(truth) > 40 and len({t[4] for t in truth}) > 2


def test_index_of_long_items_is_small():
    import pickle

    rng = random.Random(3)
    sizes = []
    for n in (2_000, 8_000):
        item = [f"w{rng.randrange(10**6)}".encode() for _ in range(n)]
        index = decontaminate.Index([(1, b" ".join(item))])
        index.segments(decontaminate.MAX_EDITS)
        sizes.append(len(pickle.dumps(index)))
        text = item[: n // 2] + [b"x", b"y"] + item[n // 2 + 1 :]
        assert decontaminate.leaks_in([b" ".join([b"a", *text, b"b"])], index, decontaminate.MAX_EDITS)[0] == [(1, 1, n + 1, 2)]
    assert sizes[1] < 40_000_000 and sizes[1] - sizes[0] < 6_000 * 600


def test_best_stretch_equals_enumeration():
    rng = random.Random(2)
    for _ in range(300):
        item, text = rng.choices("abc", k=rng.randint(1, 7)), rng.choices("abc", k=rng.randint(0, 12))
        all_of = [(decontaminate.edits_to_prefix(item, text[k:], 99), k) for k in range(len(text) + 1)]
        assert decontaminate.best_stretch(item, text, 99) == min((d, k, n) for (d, n), k in all_of)


def test_edits_to_prefix():
    assert decontaminate.edits_to_prefix(list("abcd"), list("abcdxx"), 1) == (0, 4)
    assert decontaminate.edits_to_prefix(list("abcd"), list("abdxx"), 1) == (1, 3)
    assert decontaminate.edits_to_prefix(list("abcd"), list("zzzz"), 1) is None


def test_items_with_a_common_opening_cost_no_more():
    import time

    rng = random.Random(1)
    took = []
    for n in (500, 4000):
        items = [(k, ("one of the most important " + " ".join(f"w{rng.randrange(20_000)}" for _ in range(25))).encode()) for k in range(n)]
        index = decontaminate.Index(items)
        index.segments(0.2)
        asked = items[7][1].decode().split()
        asked[10], asked[20] = "other", "words"
        text = " ".join("one of the most important " + " ".join(f"x{rng.randrange(500)}" for _ in range(8)) for _ in range(400)) + " " + " ".join(asked)
        start = time.time()
        found = decontaminate.leaks_in([text.encode()], index, 0.2)[0]
        took.append(time.time() - start)
        assert [(i, e) for i, _, _, e in found] == [(7, 2)]
    assert took[1] < 2 * took[0] + 0.1


def test_shared_segments_lose_no_item():
    """Items made of few words, so that most segments are shared: whatever is within the limit is found, as by trying every place."""
    rng = random.Random(5)
    items = [(k, " ".join(rng.choice("abcdef") for _ in range(rng.randint(6, 14))).encode()) for k in range(150)]
    index = decontaminate.Index(items)
    for _ in range(25):
        text = [rng.choice("abcdefgh") for _ in range(60)]
        found = {i for i, *_ in decontaminate.leaks_in([" ".join(text).encode()], index, 0.2)[0]}
        assert found == {k for k, words in items if decontaminate.best_stretch(words.decode().split(), text, int(0.2 * len(words.split())))}


def test_page_text(spark, small):
    import html as H

    rows = {r.page_id: r.text for r in html_text.query(spark, small).collect()}
    for i, page in duckdb.sql(f"select page_id, html from '{small}/pages.parquet'").fetchall():
        inner = re.split("</article>|<footer>", page[page.index("<article>") + 9 :])[0]
        blocks = (" ".join(H.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in re.split("</?p>|</?h1>", inner))
        assert rows[i] == "\n\n".join(b for b in blocks if b)


def test_pages_of_other_layouts(spark, small):
    model = html_text.train(spark.read.parquet(f"{small}/pages.parquet"))
    page = """<body><div class='menu'><a href=x>Home</a></div><div class='content'><h1>Title here</h1><p>Some long paragraph of text that goes on for a while, says things.</p>
      <div class=comments><p>nice comment by a reader</p></div><ul><li>item one is a list item</ul><form><p>Your name</p></form></div><div id='cookie-notice'><p>We use cookies</p></div>
      <aside><p>side text is long enough to look like content, really</p></aside><footer><p>all rights</p></footer></body>"""
    assert html_text.texts_of_pages([page], model) == ["Title here\n\nSome long paragraph of text that goes on for a while, says things.\n\nitem one is a list item"]


def test_text_of_odd_markup(spark, small):
    model = html_text.train(spark.read.parquet(f"{small}/pages.parquet"))
    page = """<article><p>let <math><mi>x</mi></math> be <object>alt</object> <noscript>ns</noscript> of it</p><p>if a <b and c</p><p>and 1 < 2 <= 3 or <3</p>
      <p title="a > b">quoted <a href='x>y'>link</a> and more text here</p><p>cdata <![CDATA[raw]]> stays<!-- not this --></p><script>no</script><textarea>no</textarea></article>"""
    got = html_text.texts_of_pages([page], model)[0].split("\n\n")
    assert got == ["let x be alt ns of it", "if a <b and c", "and 1 < 2 <= 3 or <3", "quoted link and more text here", "cdata raw stays"]
    assert html_text.texts_of_pages(["<article><p>one text of the page</p><p>two texts of the page <a href=\"x",
        "<article><p title='>it is a paragraph of text</p><p>and another one</p>"], model) == ["one text of the page\n\ntwo texts of the page",
        "it is a paragraph of text\n\nand another one"]


@pytest.mark.parametrize("part", ['<a href="', "<a ", "<", "<!--", "<![CDATA[", "</", "<p title='>", "<a \"x>", "><a \" \"", "<script>", "<div><p>"])
def test_a_page_is_read_in_linear_time(part):
    import time

    start = time.time()
    html_text.parse(part * (1_000_000 // len(part)))
    assert time.time() - start < 5


def test_names_are_learned_from_labelled_pages():
    pages = [{"html": f"<div class='zq{'ab'[k % 2]}'><p>text {k} of it</p></div><article><div class='kx'><p>long text of article {k}</p></div></article>"} for k in range(200)]
    rows = html_text._count(pa.RecordBatch.from_pylist(pages))
    model = html_text.Model(dict(zip(zip(rows["what"], rows["value"], rows["label"], strict=True), rows["n"], strict=True)))
    page = "<body><div class=zqa><p>some text that is as long as an article has it</p></div><div class=kx><p>some text that is as long as an article has it, too</p></div></body>"
    assert html_text.texts_of_pages([page], model) == ["some text that is as long as an article has it, too"]


def test_marginals_equal_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    model = html_text.Model({})
    parents = np.array([-1, 0, 0, 1, 1, 2])
    kinds = np.array([0, 0, 1, 1, 0, 1])
    pot = rng.normal(size=(6, 2))
    weight = np.zeros((6, 2))
    for y in itertools.product((0, 1), repeat=6):
        w = np.log([0.95, 0.05])[y[0]] + sum(pot[k, y[k]] for k in range(6)) + sum(model.edge[kinds[k], y[parents[k]], y[k]] for k in range(1, 6))
        for k in range(6):
            weight[k, y[k]] += math.exp(w)
    assert np.allclose(model.marginals(parents, pot, kinds), weight[:, 1] / weight.sum(axis=1))


def wrapped(text, width):
    """A notice as it stands in files: wrapped, with comment marks, punctuation and capitals."""
    w = text.split()
    return "\n".join(" * " + " ".join(w[k : k + width]).capitalize() + "," for k in range(0, len(w), width))


def test_license_notices(spark):
    rows = [(1, "this work is licensed under the GNU General Public License version 3"), (2, "the work of the public"),
        (3, "a\nLicensed under the Apache License, Version 2.0.\nb"), (4, "ALL RIGHTS\nRESERVED now")]
    rows += [(5, "all the permissions and rights that users of tables have are reserved for readers " * 30)]
    texts = [t for _, t in license_scan.TEMPLATES if len(t.split()) > 20]
    rows += [(100 + k, f"{'some words before ' * 9}\n{wrapped(t, 9)}\n{'and some after ' * 40}") for k, t in enumerate(texts)]
    out = {r.doc_id: (r.labels, r.n_base) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert [out[k] for k in (1, 2, 3, 4, 5)] == [("gpl-3", 0), ("", 0), ("apache-2", 1), ("all-rights-reserved", 0), ("", 0)]
    labels = {t: label for label, t in license_scan.TEMPLATES}
    assert all(labels[t] in out[100 + k][0].split(",") for k, t in enumerate(texts))


def test_shards_fit(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, "x" * rng.randint(0, 400)) for k in range(2000)] + [(5000, "y" * 9000)] + [(6000, "z" * 300)] * 40
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = sharding.assign_shards(docs, 4000).collect()
    assert len(out) == len(rows)
    size = Counter()
    for r in out:
        size[r.shard] += r.n_bytes
    assert all(size[r.shard] == r.shard_bytes and r.oversized == (r.shard_bytes > 4000) for r in out)
    assert {r.doc_id for r in out if r.oversized} == {5000, 6000}
    codes = sorted(size)
    assert not any(b.startswith(a) for a, b in zip(codes, codes[1:], strict=False) if len(b) < 60)  # no shard's prefix is another's
    sharding.write_shards(docs.where("doc_id < 100"), str(tmp_path / "s"), 4000)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 100


def test_every_row_reaches_one_shard(spark, tmp_path):
    rows = [(None, "x"), (1, "a"), (1, "b"), (1, "b"), (2, None), (3, "y" * 900), (None, None)] + [(k, "w" * (k % 97)) for k in range(10, 300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as shard", "2 as key", "3 as n_bytes")
    sums = {r.shard: r for r in sharding.write_shards(docs, str(tmp_path / "s"), 500).collect()}
    back = spark.read.parquet(str(tmp_path / "s")).selectExpr("shard", "row.doc_id", "row.text", "input_file_name() as f").collect()
    assert sorted(map(repr, rows)) == sorted(repr((r.doc_id, r.text)) for r in back)
    files, size = defaultdict(set), Counter()
    for r in back:
        files[r.shard].add(r.f)
        size[r.shard] += len((r.text or "").encode())
    assert all(len(f) == 1 for f in files.values()) and size == {k: r.shard_bytes for k, r in sums.items() if k in size}
    assert [r.shard for r in back if r.doc_id == 3] and sum(size[r.shard] > 500 for r in back) == 1


def test_line_dedup_counts_copies_once(spark):
    note = "cookies are used on this site, as on many others"
    rows = [(k, f"page {k} has words and more of them\n{note}\nand still more of {k}", "h") for k in range(40)] + [(50, f"own line\n{note}\n\r\n\t",
        "h"), (51, note, "h"), (52, "\r\n\t\nx", "h")]
    rows += [(100 + k, "one text\nof many copies", "h") for k in range(40)] + [(200, f"copied text\n{note}", "h")] * 9 + [(300, note, "other"), (301, None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string").selectExpr("*",
        *[f"{k} as {c}" for k, c in enumerate(("whole", "n_lines", "n_dropped", "row", "drop", "site", "here", "kept", "_text", "_drop"))])
    out = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert out[0].text == "page 0 has words and more of them\nand still more of 0" and out[100].text == "one text\nof many copies" and out[300].text == note
    assert (out[50].text, out[50].n_dropped, out[51].text, out[200].text, out[301].text) == ("own line\n\r\n\t", 1, "", "copied text", None)
    staged = line_dedup.stage(spark, docs, "").collect()
    assert len(staged) == len(rows) and staged[0].asDict().keys() == set(docs.columns) and (staged[0].whole, staged[0].n_lines, staged[0]._drop) == (0, 1, 9)


def test_simhash_stage_keeps_one_row_of_each_component(spark):
    other = " ".join(f"w{k}" for k in range(80))
    rows = [(1, "same text of some words " * 20), (1, "same text of some words " * 20), (1, other), (2, other), (None, other), (None, None), (3, ""),
        (None, "x y z"), (None, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as key", "2 as fp", "3 as row", "4 as stays")
    got = simhash.stage(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(1, rows[0][1]), (1, other), (3, ""), (None, "x y z")], key=repr)


def test_candidate_pairs_follow_the_input(spark, monkeypatch):
    """Random prints: the pairs that the second pass compares are at most FULL / 2 a member, and few where cells are split by bits."""
    monkeypatch.setattr(simhash, "FULL", 4)
    for n in (10_000, 40_000):
        rows = spark.range(n).select(F.xxhash64("id").alias("fp"))
        cells = rows.select("fp", F.explode(F.sequence(F.lit(0), F.lit(69))).alias("choice"))
        cells = cells.select("fp", F.struct("choice", simhash._masked(simhash._embedding(F.col("fp")).bitwiseAND(F.lit(0xFFFF)), F.col("choice")).alias("at")).alias("cell"))
        sizes = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 3")
        pairs = simhash.pairs_across(cells.join(sizes, "cell").select("cell", "n", "fp", F.col("fp").alias("label"))).count()
        alike = cells.groupBy("cell").agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) / 2"))).first()[0]
        assert pairs < alike / 100




def test_seeds_alone_induce_patterns_that_find_unseen_identifiers(spark):
    """No shape is trusted: what follows the seeds' contexts is found, what follows others' is not."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for k in range(120):
        contact = f"u{k}@mail.org" if k % 4 else f"member{k:05d}"
        rows.append((k, f"{word()} {word()} customer contact: {contact} {word()} {word()} ordered {rng.randint(100_000, 999_999)} pieces. {word()} room {word()}"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: r["spans"] for r in personal_data.personal_data(docs, least=0.0).collect()}
    for k, text in rows:
        if k % 4 == 0:
            at = text.index("member")
            assert found[k] == f"id:{at}:{at + 11}"
        else:
            assert found[k].startswith("email:") and "id:" not in found[k]


@pytest.mark.parametrize("every_page", [False, True])
def test_line_ratio_over_pages_or_texts(spark, every_page):
    rng = random.Random(3)
    rows = [(k, rng.choice(["a", "b", None]), "\n".join(rng.choice(["menu", "foot", "x", "y", f"own {rng.randrange(30)}", " "]) for _ in range(rng.randint(1, 4)))) for k in range(300)]
    rows += [(1000 + k, "a", "copied line\nother") for k in range(40)]
    total, holds = defaultdict(list), defaultdict(list)
    for _, host, text in rows:
        total[host].append(text)
        for line in set(text.split("\n")):
            holds[host, line].append(text)
    size = len if every_page else lambda x: len(set(x))
    bad = {key for key, texts in holds.items() if key[1].strip() and size(texts) > 1 and size(texts) > 0.1 * size(total[key[0]])}
    assert ("a", "copied line") in bad if every_page else ("a", "copied line") not in bad
    found = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id bigint, source string, text string"), ratio=0.1, every_page=every_page).collect()
    assert {r["doc_id"]: r["text"] for r in found} == {i: "\n".join(x for x in t.split("\n") if (h, x) not in bad) for i, h, t in rows}
