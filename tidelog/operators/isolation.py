"""Isolation forests whose trees grow in tasks, on the columns or on random networks of them.

Hashes of the locations deal them to the trees, so that no sample passes
through the driver and the same trees grow on any partitioning. A tree's
locations, at most size, are one group. What comes back are the trees, whose
number and size are parameters; they are broadcast, and every location is
scored in one pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

LOC = "geo_location"
EULER = 0.5772156649015329
#: Widths of the layers of a random network, the last one that of what trees see.
WIDTHS = (100, 50, 20)
#: Locations that hashes deal to a tree on average, as a multiple of its size; the lowest hashes stay.
DEALT = 3
PARTS = 1 << 20


def path_length(n) -> np.ndarray:
    """Mean depth at which a search among n random points ends."""
    n = np.asarray(n, dtype=float)
    full = 2 * (np.log(np.maximum(n - 1, 1)) + EULER) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, full, np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Networks:
    """Random networks over columns brought to mean 0 and deviation 1; none at all passes columns on as they are."""

    mean: np.ndarray
    sd: np.ndarray
    number: int
    seed: int

    def __call__(self, x: np.ndarray, net: int) -> np.ndarray:
        if not self.number:
            return x
        draw = np.random.default_rng([self.seed, net])
        x = np.clip((x - self.mean) / self.sd, -50, 50)
        for width in WIDTHS:
            x = np.tanh(x @ (draw.standard_normal((x.shape[1], width)) / math.sqrt(x.shape[1])))
        return x


def grow(x: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random tree as arrays: feature (-1 at a leaf), cut (a leaf's depth), and the upper child; the lower one follows at once."""
    limit = max(1, math.ceil(math.log2(max(len(x), 2))))
    nodes: list[list] = []
    todo = [(x, 0, -1)]
    while todo:
        rows, depth, parent = todo.pop()
        if parent >= 0:
            nodes[parent][2] = len(nodes)
        low, high = rows.min(axis=0), rows.max(axis=0)
        spread = np.flatnonzero(high > low) if len(rows) > 1 else ()
        if depth >= limit or not len(spread):
            nodes.append([-1, depth + float(path_length(len(rows))), -1])
            continue
        f = int(draw.choice(spread))
        # Above the lowest value, so that neither side is empty, however near the two ends are.
        cut = max(float(draw.uniform(low[f], high[f])), float(np.nextafter(low[f], high[f])))
        below = rows[:, f] < cut
        nodes.append([f, cut, -1])
        todo += [(rows[~below], depth + 1, len(nodes) - 1), (rows[below], depth + 1, -1)]
    feature, cut, upper = zip(*nodes, strict=True)
    return np.array(feature, np.int16), np.array(cut), np.array(upper, np.int16)


@dataclass(frozen=True)
class Forest:
    """Trees with the number of rows each has seen; consecutive trees share a network."""

    networks: Networks
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, higher for rows that few cuts set apart."""
        depth, rows, net, seen = np.zeros(len(x)), np.arange(len(x)), -1, x
        for i, (feature, cut, upper, size) in enumerate(self.trees):
            own = i * self.networks.number // len(self.trees)
            if own != net:
                net, seen = own, self.networks(x, own)
            at = np.zeros(len(x), dtype=np.int64)
            while len(inner := np.flatnonzero(feature[at] >= 0)):
                node = at[inner]
                at[inner] = np.where(seen[rows[inner], feature[node]] < cut[node], node + 1, upper[node])
            depth += cut[at] / max(float(path_length(size)), 1e-9)
        return 2.0 ** (-depth / max(len(self.trees), 1))


def dealt(rows: DataFrame, trees: int, size: int, seed: int) -> DataFrame:
    """(tree, geo_location, x) of the locations that each tree sees, size at most, by hashes of their names.

    With no more than size locations a tree sees all of them.
    """
    n = rows.count()
    if n <= size:
        return rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    copies = max(1, math.ceil(DEALT * trees * size / n))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    rows = rows.withColumn("tree", F.pmod(F.xxhash64(F.lit(seed), LOC, "copy"), F.lit(trees)).cast("int"))
    rows = rows.withColumn("lot", F.xxhash64(F.lit(seed + 1), LOC, "copy"))
    # Far more locations than trees can see: those of high lots are left out before they are shuffled.
    share = DEALT * trees * size / (n * copies)
    rows = rows.where(F.pmod("lot", F.lit(PARTS)) < math.ceil(share * PARTS)).withColumn("lot", F.struct(F.pmod("lot", F.lit(PARTS)), "lot"))
    first = rows.groupBy("tree", LOC).agg(F.min("lot").alias("lot"), F.first("x").alias("x"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("lot", LOC))
    return first.withColumn("place", place).where(F.col("place") <= size).select("tree", LOC, "x")


def fit(rows: DataFrame, trees: int, size: int = 256, networks: int = 0, seed: int = 42) -> Forest:
    """A forest of rows (geo_location, x: array of doubles), grown a tree a group.

    networks random networks are shared out evenly among the trees. Their
    input is scaled by means and deviations over all rows, cut to nine digits so that the order
    in which rows are added up doesn't matter.
    """
    net = Networks(np.zeros(0), np.ones(0), 0, seed)
    if networks:
        entries = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()
        cut = lambda v: float(f"{v:.9g}")
        net = Networks(np.array([cut(r["m"]) for r in entries]), np.array([cut(r["s"]) or 1.0 for r in entries]), networks, seed)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        tree = int(part["tree"].iloc[0])
        x = np.stack(part.sort_values(LOC, kind="stable")["x"].to_numpy())
        nodes = grow(net(x, tree * networks // trees), np.random.default_rng([seed, 1 << 20, tree]))
        return pd.DataFrame({"tree": [tree], "n": [len(x)]} | {k: [v.tobytes()] for k, v in zip(("feature", "cut", "upper"), nodes, strict=True)})

    grown = dealt(rows, trees, size, seed).groupBy("tree").applyInPandas(one, "tree int, n int, feature binary, cut binary, upper binary")
    found = sorted(grown.collect(), key=lambda r: r["tree"])
    kinds = {"feature": np.int16, "cut": np.float64, "upper": np.int16}
    return Forest(net, [(*(np.frombuffer(r[k], dtype=kind) for k, kind in kinds.items()), r["n"]) for r in found])


def scores(df: DataFrame, columns: list[str], forest: Forest, out: str) -> DataFrame:
    """df, its columns without nulls, with the forest's score."""
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @pandas_udf("double")
    def run(*parts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.column_stack([p.to_numpy(dtype=float) for p in parts])))

    return df.withColumn(out, run(*columns))
