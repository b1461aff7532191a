"""Operator 11: centroid clustering by a tournament of bisectors, in integers.

For centroids a < b the bisecting plane has the normal 2(b - a) and the threshold |b|^2 - |a|^2: a vector is nearer to b exactly if
its product with the normal exceeds the threshold, and zero difference favours the smaller number. A knockout of k - 1 such sign
tests leaves one centroid; only its distance is computed, exactly. Components are small integers in float64, where products and
sums stay below 2^53 and are exact; vectors with a component of 2^22 or more take the same steps with Python's integers.

Vectors are packed once into a table in the shared folder (four bytes a component) that every round reads. A task keeps one sum per
cluster and component, so a round shuffles at most k rows a task, whatever the vectors' number or the clusters' sizes. The driver
holds k centroids and k sums.

Defined results: vectors that are null or have another length, a null or a non-finite component are left out; a null id is hashed
as empty and kept as null; repeated rows are vectors of their own, ties in the starting order go by components; fewer vectors than
centroids give as many centroids; no vectors give no rows. Distances and inertias beyond a long are given as the largest long.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from folia.llm.common import cut, table, written

K, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, "2"
SMALL = 1 << 22  # components under it: 64 products of a normal and a vector add up to less than 2^53
LONG = (1 << 63) - 1
LIMB = 40  # bits; sums travel as digits of this size, the last one with the sign


def packed(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, small (little-endian int32 components) or, where a component is not small, wide (decimal components with commas)."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            values = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(sizes == dims)
            x = values[(np.cumsum(sizes) - sizes)[rows][:, None] + np.arange(dims)] if len(rows) else np.empty((0, dims))
            finite = np.isfinite(x).all(1)
            rows, x = rows[finite], x[finite]
            fits = (np.abs(x) < (SMALL - 1) / scale).all(1)
            ints = np.floor(np.where(fits[:, None], x, 0) * scale).astype("<i4")
            small = [v.tobytes() if ok else None for v, ok in zip(ints, fits)]
            wide = [None if ok else ",".join(str(math.floor(y * scale) if abs(y) < 2**60 else int(y) * scale) for y in v.tolist()) for v, ok in zip(x, fits)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(small, pa.binary()), pa.array(wide, pa.string())], ["vec_id", "small", "wide"])

    chosen = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return chosen.mapInArrow(run, "vec_id bigint, small binary, wide string")


def components(small: bytes | None, wide: str | None) -> list[int]:
    return np.frombuffer(small, "<i4").tolist() if wide is None else [int(x) for x in wide.split(",")]


class Bisectors:
    """Normals and thresholds of all centroid pairs, exact in float64 or, if a centroid is not small, in Python's integers."""

    def __init__(self, centroids: list[list[int]]):
        self.k = len(centroids)
        self.small = all(abs(x) < SMALL for c in centroids for x in c)
        self.centroids = np.array(centroids, object)
        self.normals = 2 * (self.centroids[None] - self.centroids[:, None])
        lengths = (self.centroids**2).sum(1)
        self.thresholds = lengths[None] - lengths[:, None]
        if self.small:
            self.fast = [x.astype(np.float64) for x in (self.centroids, self.normals, self.thresholds)]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of and squared distance to the nearest centroid for every row of x (float64 with small integers, or objects)."""
        centroids, normals, thresholds = self.fast if x.dtype != object else (self.centroids, self.normals, self.thresholds)
        slots = [np.full(len(x), c) for c in range(self.k)]
        while len(slots) > 1:  # of neighbouring slots, all numbers of the first are smaller
            after = []
            for a, b in zip(slots[::2], slots[1::2]):
                if len(slots) == self.k:
                    beyond = x @ normals[len(after) * 2, len(after) * 2 + 1] > thresholds[len(after) * 2, len(after) * 2 + 1]
                else:
                    beyond = _products(normals[a, b], x) > thresholds[a, b]
                after.append(np.where(beyond.astype(bool), b, a))
            slots = after + slots[len(after) * 2 :]
        apart = x - centroids[slots[0]]
        return slots[0], _products(apart, apart)

    def batches(self, batches):
        """(places, components, cluster, distance) of the small and of the wide rows of each Arrow batch."""
        for batch in batches:
            wide = batch.column("wide").is_valid().to_numpy(zero_copy_only=False)
            raw = batch.column("small").filter(pa.array(~wide)).to_pylist()
            small = np.frombuffer(b"".join(raw), "<i4").reshape(len(raw), -1) if raw else np.empty((0, self.centroids.shape[1]), "<i4")
            far = [[int(y) for y in x.split(",")] for x in batch.column("wide").filter(pa.array(wide)).to_pylist()]
            far = np.array(far, object).reshape(len(far), self.centroids.shape[1])
            for places, x in ((np.flatnonzero(~wide), small.astype(np.float64) if self.small else small.astype(object)), (np.flatnonzero(wide), far)):
                if len(places):
                    yield batch, places, x, *self.nearest(x)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(1) if a.dtype == object else np.einsum("ij,ij->i", a, b)


def limbs(values: list[int]) -> list[list[int]]:
    """Digits of 40 bits, the same number for every value, the last one signed: values[i] = sum of digits[j][i] << 40 j."""
    out = []
    while any(abs(v) >= 1 << LIMB for v in values):
        out.append([v & ((1 << LIMB) - 1) for v in values])
        values = [v >> LIMB for v in values]
    return [*out, values]


def sums(vectors: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """Count and exact component sums of every cluster that has vectors."""
    k, dims = len(centroids), len(centroids[0])

    def run(batches):
        judge = Bisectors(centroids)
        counts, totals = np.zeros(k, np.int64), np.full((k, dims), 0, object)
        for _, _, x, cluster, _ in judge.batches(batches):
            counts += np.bincount(cluster, minlength=k)
            if x.dtype == object:
                np.add.at(totals, cluster, x)
            else:
                member = (cluster[None] == np.arange(k)[:, None]).astype(np.float64)
                totals += (member @ x).astype(np.int64).astype(object)
        rows = [(c, j, int(counts[c]) if j == 0 else 0, digits) for c in range(k) if counts[c] for j, digits in enumerate(limbs(totals[c].tolist()))]
        for c, j, n, digits in rows:
            yield pa.RecordBatch.from_pydict({"cluster": pa.array([c], pa.int32()), "limb": pa.array([j], pa.int32()), "n": [n], "digits": pa.array([digits], pa.list_(pa.int64()))})

    partial = vectors.mapInArrow(run, "cluster int, limb int, n bigint, digits array<bigint>")
    totals = partial.groupBy("cluster", "limb").agg(F.sum("n").alias("n"), *[F.sum(F.col("digits")[i]).alias(f"d{i}") for i in range(dims)])
    found: dict[int, tuple[int, list[int]]] = {}
    for r in totals.collect():  # a few rows per cluster
        n, before = found.get(r["cluster"], (0, [0] * dims))
        found[r["cluster"]] = (n + r["n"], [s + (r[f"d{i}"] << LIMB * r["limb"]) for i, s in enumerate(before)])
    return found


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance of packed vectors."""

    def run(batches):
        for batch, places, _, cluster, distance in Bisectors(centroids).batches(batches):
            far = pa.array([min(int(d), LONG) for d in distance] if distance.dtype == object else distance.astype(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(places)), pa.array(cluster.astype(np.int32)), far], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def fit(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: str = SEED) -> list[list[int]]:
    """Centroids of packed vectors: the k first by hash of their id, then moved to their vectors' floored means in every round."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = [components(r["small"], r["wide"]) for r in vectors.orderBy(order, "small", "wide").limit(k).collect()]
    for _ in range(rounds if centroids else 0):
        moved = sums(vectors, centroids)
        after = [[s // moved[c][0] for s in moved[c][1]] if c in moved else old for c, old in enumerate(centroids)]
        if after == centroids:  # later rounds would change nothing
            break
        centroids = after
    return centroids


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every usable row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    ready = written(packed(vectors, dims, scale))
    centroids = fit(ready, k, rounds, seed)
    rows = cut(assigned(ready, centroids)) if centroids else spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint")
    inertias = {r[0]: int(r[1]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    total = sum(inertias.values())
    about = [
        Row(c, min(inertias.get(c, 0), LONG), min(total, LONG), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)
    ]
    each = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    near = "select r, any_value(v) as v, arg_min(c, d * {k} + c) as c, min(d) as d from (select k.r, k.v, c.c, list_inner_product(k.v, k.v) - 2 * list_inner_product(k.v, c.v) + list_inner_product(c.v, c.v) as d from kept k, c{n} c) group by r"
    steps = [
        f"""kept as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * cast(x as double))) as v from embeddings
 where len(embedding) = {DIMS} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {DIMS})""",
        f"c0 as materialized (select row_number() over (order by sha256('{SEED}:' || coalesce(cast(vec_id as varchar), '')), v) - 1 as c, v from kept order by 1 limit {K})",
    ]
    for n in range(ROUNDS):
        steps += [
            f"a{n} as materialized ({near.format(k=K, n=n)})",
            f"""c{n + 1} as materialized (select o.c, coalesce(m.v, o.v) as v from c{n} o left join (select c, list(m order by i) as v from (
 select c, i, floor(sum(x) / count(*)) as m from (select c, unnest(v) as x, unnest(range({DIMS})) as i from a{n}) group by c, i) group by c) m on m.c = o.c)""",
        ]
    steps.append(f"last as materialized ({near.format(k=K, n=ROUNDS)})")
    return f"""with {', '.join(steps)}
select k.vec_id, cast(l.c as integer) as cluster, cast(l.d as bigint) as distance, cast(sum(l.d) over (partition by l.c) as bigint) as cluster_inertia,
 cast(sum(l.d) over () as bigint) as inertia, sha256(array_to_string(list_transform(c.v, lambda x: cast(cast(x as bigint) as varchar)), ',')) as centroid_sha256
from last l join kept k on k.r = l.r join c{ROUNDS} c on c.c = l.c"""


SQL = _sql()
