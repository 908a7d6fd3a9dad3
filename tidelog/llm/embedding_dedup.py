"""Near-duplicate vectors by counting collisions in windows of one-dimensional projections.

Each vector, at length one, is projected on TABLES seeded Gaussian
directions. Along each of them a vector asks for those at most HALF away on
either side: a window with the query at its centre. One projection alone
leaves a fixed share of all pairs in a common window, so each is laid out in
order within the cells of a grid of DEPTH further projections, drawn anew for
each table. The order is cut at steps of one window's width: a vector stands
in one step and its window reaches into two, so an equi-join on the steps and
a comparison of the two places give exactly the pairs of a window. Common
windows are counted per pair, and pairs that have at least as many as keeps
the wanted recall are verified by their cosine.

The links of a vector are counted within its component, without listing
pairs. Members within half the threshold's angle of the component's mean
direction, its core, are all linked to each other; that is one sum. Only
members outside the core are held against all members, block against block.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import checkpoint, map_texts
from tidelog.llm.links import components, divided, joined
from tidelog.llm.minhash import _mixed

LEAST = 0.98
TABLES = 48
DEPTH = 7
WIDTH = 1.0
HALF = 0.5
RECALL = 0.9999
BLOCK = 1024
#: Rows, one a component, that are broadcast at most, by the numbers they hold; more are shuffled.
BROADCAST_NUMBERS = 1 << 22
#: Cosines this near the threshold are added up in order, as in verifying pairs; slack of the core in radians.
CLOSE = 1e-12
SLACK = 1e-6


def window_chance(least: float, width: float = WIDTH, depth: int = DEPTH, half: float = HALF) -> float:
    """Chance that of two vectors of that cosine one is in the other's window of a table."""
    spread = math.sqrt(2 - 2 * least)
    grid = (np.arange(4000) + 0.5) / 4000 * width
    density = 2 / (spread * math.sqrt(2 * math.pi)) * np.exp(-((grid / spread) ** 2) / 2)
    return float(np.sum(density * (1 - grid / width)) * width / 4000) ** depth * math.erf(half / spread / math.sqrt(2))


def least_count(least: float, tables: int = TABLES, recall: float = RECALL) -> int:
    """Most common windows that a pair at the threshold reaches with the wanted recall; 1 at least."""
    p, miss, count = window_chance(least), 0.0, 0
    while count < tables:
        miss += math.comb(tables, count) * p**count * (1 - p) ** (tables - count)
        if miss > 1 - recall:
            break
        count += 1
    return max(count, 1)


@lru_cache(maxsize=4)
def directions(dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The grids' projections, DEPTH a table, then the one that a table is ordered by; and an offset for each."""
    draw = np.random.default_rng(7_919 + dims)
    n = TABLES * (DEPTH + 1)
    return draw.standard_normal((dims, n)), draw.random(n)


def windows(vector: list[float], label: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each table: keys of the two steps that the vector's window reaches into, whether it stands in the second, and its place.

    The unit of places is a window's width, 2 * HALF. Keys hash the label,
    the table, the cell of its grid and the step.
    """
    axes, offsets = directions(len(vector))
    flat = np.array(vector) @ axes
    n = TABLES * DEPTH
    cells = np.floor(flat[:n] / WIDTH + offsets[:n]).astype(np.int64).view(np.uint64).reshape(TABLES, DEPTH)
    place = flat[n:] / (2 * HALF) + offsets[n:]
    low = np.floor(place - 0.5).astype(np.int64)
    out = _mixed(np.arange(TABLES, dtype=np.uint64) + np.uint64(label & 0xFFFFFFFFFFFFFFFF))
    for column in cells.T:
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + column)
    keys = [_mixed(out * np.uint64(0x9E3779B97F4A7C15) + step.view(np.uint64)).view(np.int64) for step in (low, low + 1)]
    return keys[0], keys[1], place >= low + 1, place


def in_window(x, y):
    """Whether the places of two rows of one key are at most half a window's width apart."""
    return F.abs(x["place"] - y["place"]) <= 0.5


def star_windows(asks: DataFrame) -> DataFrame:
    """pairs(a, b, t) of each row of asks with the two centres among those that stand in its step, if they are in its window.

    The centres are the vector that most others could meet over all steps
    and the one of lowest hash. Linked to one of them, most of a large group
    comes together with as many pairs as it has members.
    """
    meets = asks.groupBy("id").agg(F.sum("n").alias("meets"))
    one = F.struct("meets", F.xxhash64(F.lit(2), "id"), "id", "place")
    two = F.struct(F.xxhash64(F.lit(1), "id"), "id", "place")
    centres = asks.where("stands").join(meets, "id").groupBy("bucket").agg(F.max(one).alias("one"), F.min(two).alias("two"))
    both = F.array(*[F.struct(F.col(c)["id"].alias("id"), F.col(c)["place"].alias("place")) for c in ("one", "two")])
    centres = checkpoint(centres.select("bucket", F.array_distinct(both).alias("centres")))
    met = asks.select("bucket", "t", F.struct("id", "place").alias("x")).join(centres, "bucket")
    met = met.select("t", "x", F.explode("centres").alias("y"))
    x, y = F.col("x"), F.col("y")
    return met.where((x["id"] != y["id"]) & in_window(x, y)).select(F.least(x["id"], y["id"]).alias("a"), F.greatest(x["id"], y["id"]).alias("b"), "t")


def windows_across(tagged: DataFrame) -> DataFrame:
    """pairs(a, b, t) of rows of divided in one window and in different components, once for each such table.

    The smaller id asks and the larger one stands. Of a step's largest
    component, main, no two members meet.
    """
    asks = tagged.select("bucket", "t", (F.col("c") == F.col("main")).alias("in_main"), F.struct("id", "c", "place").alias("x"))
    stands = tagged.where("stands").select("bucket", (F.col("c") == F.col("main")).alias("of_main"), F.struct("id", "c", "place").alias("y"))
    x, y = F.col("x"), F.col("y")
    wanted = (x["c"] != y["c"]) & (x["id"] < y["id"]) & in_window(x, y)
    met = [asks.where("NOT in_main").join(stands, "bucket"), asks.where("in_main").join(stands.where("NOT of_main"), "bucket")]
    return met[0].where(wanted).unionByName(met[1].where(wanted)).select(x["id"].alias("a"), y["id"].alias("b"), "t")


def counted(pairs: DataFrame, least: int) -> DataFrame:
    """Those of pairs(a, b, t) that have so many different t, of 0 to 62, once each."""
    tables = F.bit_count(F.bit_or(F.expr("shiftleft(1L, t)")))
    return checkpoint(pairs.groupBy("a", "b").agg(tables.alias("n")).where(F.col("n") >= least).select("a", "b"))


def link(keys: DataFrame, verify, least: int) -> DataFrame:
    """(id, component) of vectors that verified links join; keys has id and what windows gives.

    verify(pairs) returns the linked ones of pairs(a, b), which share at
    least so many windows. After each vector has met the centres of its
    steps, all pairs of a window whose ends are still in different components
    are counted, so that no pair with enough common windows is left out.
    """
    rows = keys.select("id", F.posexplode(F.arrays_zip("low", "high", "up", "place")).alias("t", "z"))
    steps = F.array(F.struct(F.col("z.low").alias("bucket"), (~F.col("z.up")).alias("stands")), F.struct(F.col("z.high").alias("bucket"), F.col("z.up").alias("stands")))
    rows = rows.select("id", "t", F.col("z.place").alias("place"), F.explode(steps).alias("s")).select("s.bucket", "s.stands", "id", "t", "place")
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bool_or("stands").alias("met")).where("n > 1 AND met").select("bucket", "n")
    asks = checkpoint(rows.join(sizes, "bucket"))
    found = checkpoint(components(checkpoint(verify(counted(star_windows(asks), least)))))
    return joined(found, checkpoint(verify(counted(windows_across(divided(asks.drop("n"), found)), least))))


def linked(left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Which rows of left and right have that cosine; near the threshold by a sum in order of the components."""
    cosine = left @ right.T
    near = cosine >= least
    for i, j in zip(*np.nonzero(np.abs(cosine - least) < CLOSE), strict=True):
        near[i, j] = np.cumsum(left[i] * right[j])[-1] >= least
    return near


def link_weights(inside: DataFrame, least: float) -> DataFrame:
    """(id, others): weight of what each vector of inside(id, w, u, component) is linked with in its component, itself left out."""
    dims = inside.agg(F.max(F.size("u"))).first()[0] or 0
    shapes = inside.groupBy("component").agg(F.array(*[F.sum(F.get("u", F.lit(i))) for i in range(dims)]).alias("sum"))
    length = F.sqrt(F.aggregate("sum", F.lit(0.0), lambda s, x: s + F.coalesce(x * x, F.lit(0.0))))
    shapes = checkpoint(shapes.select("component", "sum", length.alias("length")))
    n_shapes = shapes.count()

    def small(side, numbers):
        """A component may hold most rows, so its one row goes to them where that fits."""
        return F.broadcast(side) if n_shapes * numbers <= BROADCAST_NUMBERS else side

    half = math.cos(max(math.acos(least) / 2 - SLACK, 0.0))
    along = F.aggregate(F.zip_with("u", "sum", lambda x, y: x * F.coalesce(y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    placed = inside.join(small(shapes, dims + 2), "component").select("id", "w", "u", "component", (along >= half * F.col("length")).alias("core"))
    placed = checkpoint(placed.withColumn("core", F.coalesce(F.col("core"), F.lit(False))))
    sizes = placed.groupBy("component").agg(F.sum(F.when(F.col("core"), F.col("w")).otherwise(0)).alias("core_w"), F.count(F.lit(1)).alias("n"), F.count_if(~F.col("core")).alias("rim"))
    sizes = checkpoint(sizes)
    sure = placed.where("core").join(small(sizes, 4), "component").select("id", (F.col("core_w") - F.col("w")).alias("others"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    block = lambda n: F.pmod(F.xxhash64("id"), blocks(n)).cast("int")
    parts = placed.join(small(sizes.where("rim > 0"), 4), "component")
    rim = parts.where("NOT core").select("id", "w", "u", "core", "component", F.lit(True).alias("asks"), block("rim").alias("one"), F.explode(F.sequence(F.lit(0), blocks("n") - 1)).alias("two"))
    every = parts.select("id", "w", "u", "core", "component", F.lit(False).alias("asks"), block("n").alias("two"), F.explode(F.sequence(F.lit(0), blocks("rim") - 1)).alias("one"))

    def count(part: pd.DataFrame) -> pd.DataFrame:
        """Linked weight of each asking vector, and of the core's vectors in those that ask."""
        asks = part["asks"].to_numpy(dtype=bool)
        ids, weights, core = part["id"].to_numpy(), part["w"].to_numpy(), part["core"].to_numpy(dtype=bool)
        matrix = np.array(part["u"].tolist(), dtype=np.float64)
        near = linked(matrix[asks], matrix[~asks], least) & (ids[asks][:, None] != ids[~asks][None, :])
        own = core[~asks]
        return pd.DataFrame({"id": np.concatenate([ids[asks], ids[~asks][own]]), "others": np.concatenate([near @ weights[~asks], weights[asks] @ near[:, own]])})

    found = rim.unionByName(every).groupBy("component", "one", "two").applyInPandas(count, "id long, others long")
    return sure.unionByName(found).groupBy("id").agg(F.sum("others").alias("others"))


def near_vectors(vectors: DataFrame, least: float = LEAST, id_col="vec_id", vector_col="embedding", label_col="label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of equal label, of whatever type, and equal length in components are linked where
    their cosine, in double precision, is at least the threshold. Vectors
    that are null, zero or hold null or non-finite components, and those of
    null label or id, link with nothing: n_links 0, component_id the own id.
    component_id is the smallest id that links reach; kept marks the rows
    that have it, and rows of null id. Rows that repeat an id are one vector
    if they are equal; their copies count as links. An empty table gives no
    rows.
    """
    rows = vectors.select(
        vectors[id_col].cast("long").alias("vec_id"),
        vectors[label_col].alias("label"),
        vectors[vector_col].cast("array<double>").alias("v"),
    )
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = checkpoint(rows.withColumn("ok", F.coalesce(sound & (top > 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))))
    classes = rows.where("ok").groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("w"))
    scaled = F.transform("v", lambda x: x / top)
    norm = F.sqrt(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x))
    unit = classes.withColumn("u", scaled).withColumn("u", F.transform("u", lambda x: x / norm))
    classes = checkpoint(unit.select("id", "label", "w", "v", "u"))
    # Equal ids with different vectors stay apart by their smallest class.
    nodes = checkpoint(classes.dropDuplicates(["id"]))

    def work(id, kind, u):
        low, high, up, place = zip(*(windows(x, y) for x, y in zip(u, kind, strict=True)), strict=True)
        return {"id": id, "low": list(low), "high": list(high), "up": list(up), "place": list(place)}

    schema = {
        "id": ("long", pa.int64()),
        "low": ("array<long>", pa.list_(pa.int64())),
        "high": ("array<long>", pa.list_(pa.int64())),
        "up": ("array<boolean>", pa.list_(pa.bool_())),
        "place": ("array<double>", pa.list_(pa.float64())),
    }
    keys = checkpoint(map_texts(nodes.withColumn("kind", F.xxhash64("label")), ["id", "kind", "u"], work, schema))

    def verify(pairs):
        left = nodes.select(F.col("id").alias("a"), F.col("u").alias("ua"), F.col("label").alias("la"))
        right = nodes.select(F.col("id").alias("b"), F.col("u").alias("ub"), F.col("label").alias("lb"))
        both = pairs.join(left, "a").join(right, "b").where((F.col("la") == F.col("lb")) & (F.size("ua") == F.size("ub")))
        cosine = F.aggregate(F.zip_with("ua", "ub", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return both.where(cosine >= least).select("a", "b")

    found = checkpoint(link(keys, verify, least_count(least)))
    counts = link_weights(checkpoint(found.join(nodes.select("id", "w", "u"), "id")), least)
    facts = classes.select("id", "label", "v", "w").join(counts, "id", "left").join(found, "id", "left")
    facts = facts.select("label", "v", (F.col("w") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("c"))
    good = rows.where("ok").join(facts, ["label", "v"]).select("vec_id", "n", "c")
    alone = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("c"))
    out = good.unionByName(alone)
    return out.select("vec_id", F.col("n").alias("n_links"), F.col("c").alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )
