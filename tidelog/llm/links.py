"""Linking items that share buckets, and the connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import checkpoint

#: Sets of ids up to this many (8 bytes each) are broadcast to filter a table; larger ones are shuffled.
BROADCAST_IDS = 1_000_000
MAX_STEPS = 60


def only(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of df whose column is in ids(id); ids is materialised and has no repeats."""
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return df.join(side, df[column] == ids["id"], "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each end of edges(a, b): the smallest id that can be reached.

    Alternates large-star and small-star steps until the edges are stars;
    every group is reduced by a minimum and joined back. The minima are
    written before the join, so that both sides of it are plain shuffles and
    adaptive execution can split the rows of a hub. The number of steps grows
    with the logarithm of the longest path.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = checkpoint(edges.distinct())

    def unfinished(df):
        """Whether an id has two smaller neighbours, or has both a smaller and a larger one."""
        side = lambda end, up, down: F.struct(F.col(end).alias("id"), F.lit(up).alias("up"), F.lit(down).alias("down"))
        ends = df.select(F.explode(F.array(side("a", 1, 0), side("b", 0, 1))).alias("e"))
        ends = ends.groupBy("e.id").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
        return ends.agg(F.bool_or((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]

    for _ in range(MAX_STEPS):
        if not unfinished(edges):
            break
        both = F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in (("a", "b"), ("b", "a"))])
        both = edges.select(F.explode(both).alias("e")).select("e.a", "e.b")
        least = checkpoint(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = checkpoint(large)
        least = checkpoint(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpoint(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    else:
        raise RuntimeError(f"components not settled after {MAX_STEPS} steps")
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def joined(found: DataFrame, edges: DataFrame) -> DataFrame:
    """components of what found(id, component) was made from and of edges(a, b); only components that edges meet are worked on."""
    of = lambda end: found.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
    ends = edges.join(of("a"), "a", "left").join(of("b"), "b", "left")
    over = components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    fresh = over.join(found.select("id"), "id", "left_anti").select("id", "component")
    moved = found.join(over.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
    return moved.select("id", F.coalesce("to", "component").alias("component")).unionByName(fresh)


def in_company(members: DataFrame) -> DataFrame:
    """(bucket, id, n) of members whose bucket has n > 1 of them."""
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return checkpoint(members.join(sizes, "bucket").select("bucket", "id", "n"))


def star_pairs(live: DataFrame) -> DataFrame:
    """pairs(a, b) of each member of in_company with the two centres of its bucket, once for each bucket that has them.

    The centres are the member that meets most others over all buckets and
    the one of lowest hash. Linked to one of them, most of a large group
    comes together with as many pairs as it has members.
    """
    meets = live.groupBy("id").agg(F.sum("n").alias("meets"))
    live = checkpoint(live.select("bucket", "id").join(meets, "id"))
    centres = live.groupBy("bucket").agg(
        F.max(F.struct("meets", F.xxhash64(F.lit(2), "id"), "id"))["id"].alias("c1"),
        F.min(F.struct(F.xxhash64(F.lit(1), "id"), "id"))["id"].alias("c2"),
    )
    stars = live.join(checkpoint(centres), "bucket").select("id", F.explode(F.array_distinct(F.array("c1", "c2"))).alias("c")).where("id != c")
    return stars.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b"))


def divided(members: DataFrame, found: DataFrame) -> DataFrame:
    """members of the buckets that hold more than one component of found, with c, their own, and main, the bucket's largest."""
    at = members.join(found.select("id", "component"), "id", "left")
    at = checkpoint(at.withColumn("c", F.coalesce("component", "id")).drop("component"))
    parts = at.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("n"))
    split = parts.groupBy("bucket").agg(F.max(F.struct("n", "c"))["c"].alias("main"), F.count(F.lit(1)).alias("k"))
    return checkpoint(at.join(checkpoint(split.where("k > 1").select("bucket", "main")), "bucket"))


def across(tagged: DataFrame, condition) -> DataFrame:
    """pairs(a, b) of members of divided in one bucket and in different components, once for each such bucket.

    Members of a bucket's largest component aren't paired with each other.
    condition(x, y) restricts the pairs; x and y give a column by its name.
    """
    names = [c for c in tagged.columns if c not in ("bucket", "main")]
    rest = tagged.where("c != main").select("bucket", F.struct(*names).alias("x"))
    whole = tagged.select("bucket", "main", F.struct(*names).alias("y"))
    x, y = F.col("x"), F.col("y")
    once = (y["c"] == F.col("main")) | (x["id"] < y["id"])
    met = rest.join(whole, "bucket").where((x["c"] != y["c"]) & once & condition(x.getField, y.getField))
    return met.select(F.least(x["id"], y["id"]).alias("a"), F.greatest(x["id"], y["id"]).alias("b"))


def counted(pairs: DataFrame, least: int = 1) -> DataFrame:
    """Those of pairs(a, b) that occur so often, once each."""
    return checkpoint(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("a", "b"))
