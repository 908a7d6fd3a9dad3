"""Centroid clustering against plain rounds over all distances."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import centroids


def plain(vectors, k, rounds, dims=64, scale=1024, seed=3):
    """vectors: (vec_id, list). All distances in every round, with Python's integers."""
    ok = lambda v: v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    bound = lambda x: max(-centroids.LARGEST, min(centroids.LARGEST, math.floor(scale * x)))
    kept = [(i, [bound(x) for x in v]) for i, v in vectors if ok(v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    middle = [v for _, v in order[:k]]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(middle)) for _, v in kept]

    for _ in range(rounds):
        own = [c for _, c in nearest()]
        for c in range(len(middle)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            if mine:
                middle[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = nearest()
    inertia = {c: sum(d for d, o in found if o == c) for _, c in found}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for (i, _), (d, c) in zip(kept, found, strict=True)), key=repr)


def frame(spark, vectors, kind="float"):
    return spark.createDataFrame(vectors, f"vec_id long, embedding array<{kind}>")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_clusters_match_plain_rounds(spark):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(6, 64))
    vectors = [(i, (middle[i % 6] + 0.6 * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(400)]
    df = frame(spark, vectors).repartition(5)
    assert got(centroids.clusters(df)) == plain(vectors, 8, 10)
    wide = df.withColumns({c: F.lit("x") for c in ("cluster", "was", "lower", "x", "n", "distance", "key")})
    assert got(centroids.clusters(wide, k=5, rounds=3, seed=4)) == plain(vectors, 5, 3, seed=4)


def test_ties_go_to_the_smaller_number(spark):
    # On a grid of few points most vectors are equally near to several centroids.
    rng = np.random.default_rng(6)
    vectors = [(i, rng.integers(0, 2, size=4).astype(float).tolist()) for i in range(200)]
    assert got(centroids.clusters(frame(spark, vectors, "double"), k=6, rounds=4, dims=4)) == plain(vectors, 6, 4, dims=4)


def test_unsound_vectors_are_left_out_and_large_ones_stop(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [-0.5, 1e-9]), (2, [1e30, -1e30]), (3, [3.0, -1e-9]), (4, None), (5, []), (6, [1.0]), (7, [1.0, None]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [1.0, 2.0, 3.0])]
    out = got(centroids.clusters(frame(spark, vectors, "double"), k=3, dims=2))
    assert out == plain(vectors, 3, 10, dims=2) and len(out) == 5
    few = got(centroids.clusters(frame(spark, vectors, "double"), k=50, dims=2))
    assert few == plain(vectors, 50, 10, dims=2)
    assert got(centroids.clusters(frame(spark, []))) == []


@pytest.mark.parametrize("dims", [2, 16])
def test_bounds_hold_and_spare_distances(dims):
    rng = np.random.default_rng(dims)
    v = (rng.integers(0, 8, size=(4000, 1)) * 4000 + rng.integers(-600, 600, size=(4000, dims))).astype(np.int64)
    middle = v[:8].copy()
    n = len(v)
    cluster, upper, lower = np.zeros(n, np.int32), np.full(n, np.inf, np.float32), np.zeros((n, 8), np.float32)
    spent = []
    for _ in range(8):
        spent.append(centroids.assign(v, cluster, upper, lower, middle))
        every = ((v[:, None, :] - middle[None]) ** 2).sum(axis=2)
        assert (cluster == every.argmin(axis=1)).all()
        assert (upper.astype(float) >= np.sqrt(every[np.arange(n), cluster])).all()
        assert (lower.astype(float) <= np.sqrt(every)).all()
        after = np.array([v[cluster == c].sum(axis=0) // (cluster == c).sum() if (cluster == c).any() else middle[c] for c in range(8)])
        went, middle = centroids.drift(middle, after).astype(float), after
        upper, lower = centroids._up(upper + went[cluster]), centroids._down(lower - went)
    assert spent[0] < 8 * n and spent[-1] < n
