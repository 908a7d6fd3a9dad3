"""A variational autoencoder whose slopes are added up over tasks.

Rows are dealt to batches by a hash of the location, and a batch's rows to
blocks of which each is one task's and kept in memory. A step is a job over the blocks
of its batch alone; their number goes by the rows of a batch, not by how many
partitions the rows came in. A task runs its rows forward and back and
returns one sum of losses and slopes; sums of many tasks meet in a few groups before they
come to the driver, which holds the weights and takes the step. Noise and dropout of a row follow
from its hash and the epoch, so training doesn't depend on how rows lie in
partitions, but for the order of additions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from tidelog.storage import settled

LOC = "geo_location"
HIDDEN, LATENTS, DROPOUT = (128, 64), 16, 0.1
#: Rows of a batch at least, and batches of an epoch at most: each is a job.
BATCH, MOST_BATCHES = 256, 8
#: Rows for which a batch gets another task, as long as there are cores for it, and rows of a task on average at most.
SHARE, MOST_ROWS = 256, 1 << 16
#: Tasks of a batch beyond which their sums meet in groups.
MEET = 16
BOUND = 8.0
ROWS = 512


def shapes(inputs: int) -> dict[str, tuple[int, int]]:
    """The layers: e1, e2 down to the heads m (mean) and v (logarithm of the variance), d1 to d3 back."""
    a, b = HIDDEN
    return {"e1": (inputs, a), "e2": (a, b), "m": (b, LATENTS), "v": (b, LATENTS), "d1": (LATENTS, b), "d2": (b, a), "d3": (a, inputs)}


def begin(inputs: int, seed: int) -> dict[str, np.ndarray]:
    """Random weights, each layer with its offsets as a last row."""
    draw = np.random.default_rng(seed)
    spread = lambda k, n: math.sqrt(2 / n) * (0.1 if k == "v" else 1.0)
    return {k: np.vstack([draw.normal(0, spread(k, n), (n, m)), np.zeros((1, m))]) for k, (n, m) in shapes(inputs).items()}


def _through(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ p[:-1] + p[-1]


def encode(p: dict, x: np.ndarray, masks=(1.0, 1.0)):
    h1 = np.maximum(_through(p["e1"], x), 0) * masks[0]
    h2 = np.maximum(_through(p["e2"], h1), 0) * masks[1]
    return h1, h2, _through(p["m"], h2), np.clip(_through(p["v"], h2), -BOUND, BOUND)


def decode(p: dict, z: np.ndarray, masks=(1.0, 1.0)):
    g1 = np.maximum(_through(p["d1"], z), 0) * masks[0]
    g2 = np.maximum(_through(p["d2"], g1), 0) * masks[1]
    return g1, g2, _through(p["d3"], g2)


def sums(p: dict, x: np.ndarray, w: np.ndarray, noise: np.ndarray, masks: list, beta: float) -> tuple[float, dict[str, np.ndarray]]:
    """Sum of w * (mean squared error + beta * divergence) over rows, and its slopes by the weights."""
    h1, h2, mean, log_var = encode(p, x, masks[:2])
    sd = np.exp(log_var / 2)
    z = mean + sd * noise
    g1, g2, out = decode(p, z, masks[2:])
    off, w = out - x, w[:, None]
    loss = float((w * (off**2).mean(axis=1, keepdims=True)).sum() + beta * (w * -0.5 * (1 + log_var - mean**2 - sd**2)).sum())
    slopes = {}

    def back(name, inner, outer):
        """Slopes of a layer, and what its input gets."""
        slopes[name] = np.vstack([inner.T @ outer, outer.sum(axis=0)])
        return outer @ p[name][:-1].T

    d = back("d3", g2, 2 * w * off / x.shape[1]) * masks[3] * (g2 > 0)
    d = back("d2", g1, d) * masks[2] * (g1 > 0)
    d_z = back("d1", z, d)
    inside = np.abs(log_var) < BOUND
    d = back("m", h2, d_z + beta * w * mean) + back("v", h2, (d_z * noise * sd / 2 + beta * w * 0.5 * (sd**2 - 1)) * inside)
    d = back("e2", h1, d * masks[1] * (h2 > 0))
    back("e1", x, d * masks[0] * (h1 > 0))
    return loss, slopes


def chances(lots: np.ndarray, epoch: int, seed: int, dropout: float) -> tuple[np.ndarray, list]:
    """Noise of the latents and masks of the hidden layers, a generator a row and epoch."""
    a, b = HIDDEN
    ends = np.cumsum([a, b, b, a])
    noise, kept = np.empty((len(lots), LATENTS)), np.empty((len(lots), ends[-1]))
    for i, lot in enumerate(lots):
        draw = np.random.Generator(np.random.Philox(key=[int(lot) & (2**64 - 1), seed << 32 | epoch]))
        noise[i] = draw.standard_normal(LATENTS)
        kept[i] = draw.random(ends[-1]) if dropout else 1.0
    return noise, [(m >= dropout) / (1 - dropout) for m in np.split(kept, ends[:-1], axis=1)]


def _flat(loss: float, weight: float, slopes: dict) -> np.ndarray:
    return np.concatenate([[loss, weight], *[slopes[k].ravel() for k in sorted(slopes)]])


@dataclass(frozen=True)
class Autoencoder:
    """Weights, and the means and deviations of the columns that they were learned on."""

    weights: dict[str, np.ndarray]
    mean: np.ndarray
    sd: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.sd, -50, 50)

    def latents(self, x: np.ndarray) -> np.ndarray:
        return encode(self.weights, self.scaled(x))[2]

    def error(self, x: np.ndarray) -> np.ndarray:
        return ((decode(self.weights, self.latents(x))[2] - self.scaled(x)) ** 2).mean(axis=1)


def dealt(rows: DataFrame, seed: int) -> list[RDD]:
    """The blocks (lots, x, w) of each batch, a task's each, of rows (geo_location, x, w)."""
    lot = F.xxhash64(F.lit(seed), LOC)
    n = rows.count()
    batches = max(1, min(MOST_BATCHES, n // BATCH))
    each = n / batches
    tasks = max(1, min(math.ceil(each / SHARE), rows.sparkSession.sparkContext.defaultParallelism), math.ceil(each / MOST_ROWS))
    # The batch takes a lot's last signs, the block others.
    rows = rows.select(lot.alias("lot"), F.pmod(lot, F.lit(batches)).alias("batch"), F.pmod(F.shiftright(lot, 16), F.lit(tasks)).cast("int").alias("block"), "x", "w")

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("lot")
        found = {"lots": part["lot"].to_numpy(), "x": np.stack(part["x"].to_numpy()), "w": part["w"].to_numpy()}
        return pd.DataFrame({k: [part[k].iloc[0]] for k in ("batch", "block")} | {k: [np.ascontiguousarray(v).tobytes()] for k, v in found.items()})

    packed = settled(rows.groupBy("batch", "block").applyInPandas(pack, "batch long, block int, lots binary, x binary, w binary"))

    def unpack(r):
        lots, x, w = (np.frombuffer(r[k], kind) for k, kind in (("lots", np.int64), ("x", np.float64), ("w", np.float64)))
        return r["block"], (lots, x.reshape(len(lots), -1), w)

    own = [packed.where(F.col("batch") == batch).rdd.map(unpack) for batch in range(batches)]
    return [blocks.partitionBy(tasks, lambda block: block).values().persist(StorageLevel.MEMORY_AND_DISK) for blocks in own]


def fit(
    rows: DataFrame, epochs: int = 100, patience: int = 15, rate: float = 1e-3, decay: float = 1e-5, dropout: float = DROPOUT, seed: int = 42
) -> Autoencoder:
    """An autoencoder of rows (geo_location, x: array of doubles, w: weight).

    The divergence's weight rises over the first twenty epochs. Training ends after patience
    epochs without a lower loss, and the best epoch's weights stay.
    """
    entries = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()
    # Nine digits, so that the order in which rows are added up moves nothing.
    cut = lambda v: float(f"{v:.9g}")
    net = Autoencoder(begin(len(entries), seed), np.array([cut(r["m"]) for r in entries]), np.array([cut(r["s"]) or 1.0 for r in entries]))
    batches = dealt(rows, seed)
    p = net.weights
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    best, kept, waited, step = math.inf, p, 0, 0

    def total(blocks: RDD, epoch: int, beta: float) -> np.ndarray:
        # The weights go with the job, which spares each step a broadcast of its own.
        model = Autoencoder(p, net.mean, net.sd)

        def run(block) -> np.ndarray:
            found = 0.0
            for at in range(0, len(block[0]), ROWS):
                lots, x, w = (part[at : at + ROWS] for part in block)
                noise, masks = chances(lots, epoch, seed, dropout)
                loss, slopes = sums(model.weights, model.scaled(x), w, noise, masks, beta)
                found = found + _flat(loss, float(w.sum()), slopes)
            return found

        found, zero = blocks.map(run), np.zeros(2 + sum(v.size for v in p.values()))
        return sum(found.collect(), zero) if blocks.getNumPartitions() <= MEET else found.treeAggregate(zero, np.add, np.add)

    for epoch in range(1, epochs + 1):
        beta, losses, weights = min(1.0, epoch / 20) / len(entries), 0.0, 0.0
        before = p
        for blocks in batches:
            loss, weight, *slopes = total(blocks, epoch, beta)
            if not weight:
                continue
            losses, weights, step, at = losses + loss, weights + weight, step + 1, 0
            after = {}
            for k in sorted(p):
                s = np.array(slopes[at : at + p[k].size]).reshape(p[k].shape) / weight + decay * p[k]
                at += p[k].size
                first[k], second[k] = 0.9 * first[k] + 0.1 * s, 0.999 * second[k] + 0.001 * s**2
                after[k] = p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            p = after
        if losses / max(weights, 1e-300) < best - 1e-5:
            best, kept, waited = losses / weights, before, 0
        else:
            waited += 1
            if waited >= patience:
                break
    for blocks in batches:
        blocks.unpersist()
    return Autoencoder(kept, net.mean, net.sd)


def judged(rows: DataFrame, net: Autoencoder) -> DataFrame:
    """(geo_location, error, latents) of rows (geo_location, x)."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    @pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        some = np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(shared.value.mean)))
        return pd.Series(list(np.column_stack([shared.value.error(some), shared.value.latents(some)])))

    found = rows.select(LOC, run("x").alias("v"))
    return found.select(LOC, F.col("v")[0].alias("error"), F.slice("v", 2, LATENTS).alias("latents"))
