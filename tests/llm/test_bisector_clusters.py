"""Operator 11 against all distances in plain Python, ties, odd vectors and huge components."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from folia.llm import bisector_clusters as B


def plain(rows, k, rounds, dims):
    """(vec_id, cluster, distance, centroid) of every usable row, by all distances, in Python's integers."""
    kept = [(i, [math.floor(Fraction(x) * B.SCALE) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda r: hashlib.sha256(f"{B.SEED}:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=name)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    return [(i, near(v)[1], min(near(v)[0], B.LONG), hashlib.sha256(",".join(map(str, centroids[near(v)[1]])).encode()).hexdigest()) for i, v in kept]


def vectors(kind):
    rng = random.Random(kind)
    if kind == "grid":  # many ties and repeated vectors
        rows = [(k, [rng.choice([-1.0, 0.0, 1.0]) / 256 for _ in range(4)]) for k in range(300)]
    elif kind == "huge":
        rows = [(k, [rng.choice([1.0, -1.0]) * 10.0 ** rng.randint(-5, 307) for _ in range(4)]) for k in range(120)]
    else:
        rows = [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(300)]
    odd = [None, [], [1.0] * 3, [1.0] * 5, [1.0, None, 1.0, 1.0], [1.0, float("nan"), 1.0, 1.0], [1.0, float("inf"), 1.0, 1.0]]
    return rows + [(1000 + k, v) for k, v in enumerate(odd)] + [(None, rows[0][1]), (5, rows[5][1]), (5, rows[5][1])]


@pytest.mark.parametrize("kind", ["grid", "huge", "plain"])
@pytest.mark.parametrize("k", [1, 7, 40])
def test_clusters(spark, kind, k):
    rows = vectors(kind)
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as cluster", "2 as n").repartition(3)
    found = B.clusters(table, k=k, dims=4).collect()
    expected = plain(rows, k, B.ROUNDS, 4)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"], r["centroid_sha256"]) for r in found), key=str) == sorted(expected, key=str)
    sums = {c: min(sum(e[2] for e in expected if e[1] == c), B.LONG) for c in {e[1] for e in expected}}
    assert all(r["cluster_inertia"] == sums[r["cluster"]] and r["inertia"] == min(sum(e[2] for e in expected), B.LONG) for r in found)


def test_fewer_vectors_than_centroids_and_none(spark):
    two = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert sorted(r["distance"] for r in B.clusters(two, dims=2).collect()) == [0, 0]
    assert B.clusters(two.limit(0), dims=2).collect() == []


def test_a_tournament_takes_the_smaller_number_of_equals():
    judge = B.Bisectors([[5, 0], [0, 0], [2, 0], [0, 0], [2, 0]])
    cluster, distance = judge.nearest(np.array([[1.0, 0.0], [2.0, 0.0], [0.0, 3.0]]))
    assert cluster.tolist() == [1, 2, 1] and distance.tolist() == [1, 0, 9]


def test_limbs():
    values = [0, -1, 1 << 39, -(1 << 90) + 7, 10**40]
    digits = B.limbs(values)
    assert [sum(d[i] << B.LIMB * j for j, d in enumerate(digits)) for i in range(len(values))] == values
    assert all(-(1 << B.LIMB) < x < 1 << B.LIMB for d in digits for x in d)
