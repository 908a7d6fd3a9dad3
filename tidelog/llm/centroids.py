"""Centroid clustering of integer vectors with Elkan's bounds.

Each vector carries its cluster, an upper bound of its distance to that
cluster's centroid and a lower bound of its distance to every centroid. When
centroids move, bounds move with them; a distance is computed only where the
bounds, or half the distance between two centroids, can't rule the centroid
out. Bounds are rounded to the safe side and rule out strictly, so centroids
that are equally near are always compared by their exact integer distances.

A round is one pass that writes vectors and bounds as a table in the shared
folder, and one that adds up the vectors that changed their cluster: sums are
integers, so they can be carried from round to round without loss. Only k
rows of sums come to the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import delete_folder, shared_folder

#: Components stop here on both sides, so that squared distances over 64 of them fit in 64 bits.
LARGEST = 1 << 27
MOST = (1 << 63) - 1
#: Slack for the rounding of square roots and sums of doubles; far below a float's own step.
SLACK = 1e-12

STATE = "vec_id long, v binary, cluster int, was int, upper float, lower binary"
STATE_ARROW = pa.schema(
    [("vec_id", pa.int64()), ("v", pa.binary()), ("cluster", pa.int32()), ("was", pa.int32()), ("upper", pa.float32()), ("lower", pa.binary())]
)


def _up(x: np.ndarray) -> np.ndarray:
    """The least float not below x and its slack."""
    x = np.asarray(x, dtype=np.float64) * (1 + SLACK)
    y = x.astype(np.float32)
    return np.where(y < x, np.nextafter(y, np.float32(np.inf)), y)


def _down(x: np.ndarray) -> np.ndarray:
    """The greatest float, 0 at least, not above x less its slack."""
    x = np.maximum(np.asarray(x, dtype=np.float64) * (1 - SLACK), 0.0)
    y = x.astype(np.float32)
    return np.where(y > x, np.nextafter(y, np.float32(-np.inf)), y)


def squared(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    off = v - w
    return np.einsum("ij,ij->i", off, off)


def between(centroids: np.ndarray) -> np.ndarray:
    """Half the distance of each two centroids, rounded down; infinite to itself."""
    out = np.full((len(centroids),) * 2, np.inf, dtype=np.float32)
    for i, c in enumerate(centroids):
        rest = np.arange(len(centroids)) != i
        out[i, rest] = _down(np.sqrt(squared(centroids[rest], c).astype(np.float64)) / 2)
    return out


def drift(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """How far each centroid went, rounded up."""
    return _up(np.sqrt(squared(before, after).astype(np.float64)))


def assign(v, cluster, upper, lower, centroids) -> int:
    """Give every vector its nearest centroid, the first of equally near ones; the number of distances computed.

    cluster, upper and lower are changed in place; on entry the bounds hold for
    the given centroids.
    """
    half = between(centroids)
    upper_of = upper[:, None]
    open_to = (upper_of >= lower) & (upper_of >= half[cluster])
    open_to[np.arange(len(v)), cluster] = False
    live = np.flatnonzero(open_to.any(axis=1))
    best = squared(v[live], centroids[cluster[live]])
    root = np.sqrt(best.astype(np.float64))
    upper[live], lower[live, cluster[live]] = _up(root), _down(root)
    computed = len(live)
    for c in range(len(centroids)):
        own = cluster[live]
        at = np.flatnonzero((own != c) & (upper[live] >= lower[live, c]) & (upper[live] >= half[own, c]))
        found = squared(v[live[at]], centroids[c])
        computed += len(at)
        root = np.sqrt(found.astype(np.float64))
        lower[live[at], c] = _down(root)
        nearer = (found < best[at]) | ((found == best[at]) & (c < own[at]))
        to = live[at[nearer]]
        cluster[to], upper[to] = c, _up(root[nearer])
        best[at[nearer]] = found[nearer]
    return computed


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, at most LARGEST on either side."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x.astype(np.float64)), -LARGEST, LARGEST).astype(np.int64)


def _blobs(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    return pa.array([r.tobytes() for r in rows], type=pa.binary())


def _numbers(column: pa.Array, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, width)


def sound(vectors: DataFrame, dims: int, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x) of the vectors with exactly dims components, none null, NaN or infinite."""
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where((F.size("x") == dims) & F.coalesce(finite, F.lit(False)))


def first_centroids(rows: DataFrame, k: int, seed: int, scale: int) -> np.ndarray:
    """The k vectors of smallest sha256 of the seed and the id, in that order; equal ids by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = rows.select(key.alias("key"), "x").orderBy("key", "x").limit(k).collect()
    return integers(np.array([r["x"] for r in found], dtype=np.float64), scale)


def clusters(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    dims: int = 64,
    scale: int = 1024,
    seed: int = 3,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every sound vector.

    Vectors without exactly dims components, or with a null, NaN or infinite
    one, are left out. A component x counts as floor(scale * x), held within
    LARGEST. The first centroids are the k vectors of smallest hash, or all
    vectors if there are fewer. Each round assigns all vectors and replaces
    each centroid that has vectors by the floor of their mean; rounds end
    early once no centroid moves, as the further ones would change nothing.
    Then vectors are assigned once more. Of equally near centroids the
    smaller number wins. Rows that repeat an id are vectors of their own; a
    null id hashes as an empty text. Inertias beyond 64 bits stop at the
    largest long. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = sound(vectors, dims, id_col, vec_col)
    centroids = first_centroids(rows, k, seed, scale)
    if not len(centroids):
        return spark.createDataFrame(
            [], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        )
    k = len(centroids)
    folder = shared_folder(spark, "clusters")

    def first(batches, centroids):
        for b in batches:
            v = integers(b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), scale)
            n = len(v)
            yield b.column("vec_id"), v, np.zeros(n, np.int32), np.full(n, -1, np.int32), np.full(n, np.inf, np.float32), np.zeros((n, k), np.float32)

    def later(batches, went):
        for b in batches:
            v = _numbers(b.column("v"), np.int32, dims).astype(np.int64)
            cluster = b.column("cluster").to_numpy(zero_copy_only=False).copy()
            upper = _up(b.column("upper").to_numpy(zero_copy_only=False).astype(np.float64) + went[cluster])
            lower = _down(_numbers(b.column("lower"), np.float32, k).astype(np.float64) - went)
            yield b.column("vec_id"), v, cluster, cluster.copy(), upper, lower

    def moved(start, centroids, went):
        """A pass that assigns vectors and returns them with their new bounds."""

        def run(batches):
            for ids, v, cluster, was, upper, lower in start(batches, went):
                assign(v, cluster, upper, lower, centroids)
                yield pa.RecordBatch.from_arrays(
                    [ids, _blobs(v.astype(np.int32)), pa.array(cluster), pa.array(was), pa.array(upper), _blobs(lower)], schema=STATE_ARROW
                )

        return run

    def sums(batches):
        """Numbers and sums that the rows of a task bring to each cluster or take from it."""
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            v = _numbers(b.column("v"), np.int32, dims).astype(np.int64)
            for name, sign in (("cluster", 1), ("was", -1)):
                at = b.column(name).to_numpy(zero_copy_only=False)
                for c in np.unique(at[at >= 0]):
                    n[c] += sign * int((at == c).sum())
                    total[c] += sign * v[at == c].sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(k), type=pa.int32()), pa.array(n), pa.array(total.tolist(), type=pa.list_(pa.int64()))], names=["cluster", "n", "total"]
        )

    counts, totals = [0] * k, [[0] * dims for _ in range(k)]
    state, start, went, path = rows, first, None, None
    for i in range(rounds):
        at = f"{folder}/{i}"
        state.mapInArrow(moved(start, centroids, went), STATE).write.parquet(at)
        if path is not None:
            delete_folder(spark, path)
        state, start, path = spark.read.parquet(at), later, at
        changed = state.where("cluster <> was").select("v", "cluster", "was").mapInArrow(sums, "cluster int, n long, total array<long>")
        added = changed.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[j]) for j in range(dims)]).alias("total"))
        for r in added.collect():
            counts[r["cluster"]] += r["n"]
            totals[r["cluster"]] = [a + b for a, b in zip(totals[r["cluster"]], r["total"], strict=True)]
        # Python's division of integers is exact and rounds down.
        after = np.array([[t // counts[c] for t in totals[c]] if counts[c] else centroids[c] for c in range(k)], dtype=np.int64)
        went, centroids = drift(centroids, after).astype(np.float64), after
        if not went.any():
            break

    def last(batches):
        for ids, v, cluster, _, upper, lower in start(batches, went):
            assign(v, cluster, upper, lower, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(squared(v, centroids[cluster]))], names=["vec_id", "cluster", "distance"])

    state.mapInArrow(last, "vec_id long, cluster int, distance long").write.parquet(f"{folder}/last")
    if path is not None:
        delete_folder(spark, path)
    found = spark.read.parquet(f"{folder}/last")
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    every = min(sum(inertia.values()), MOST)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = spark.createDataFrame(
        [(c, min(s, MOST), every, digest[c]) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
