"""Mixing sources to target weights by Sainte-Lague apportionment (DataFrame operations only).

Each source's documents form a stream in a seeded order, cut into blocks of
equally many words. The highest quotients target / (2 k + 1) over all
sources win the seats of the mix, a seat being one block. The seats of the
first shards form a smaller house of the same apportionment, so each
shard's quotas are differences of two houses and are whole numbers. A
source's seats follow each other through the shards, each shard as many as
its quota, and a seat takes the next block of the source in the order of a
seeded affine permutation; after the last block a further pass begins.

A block holds at least one 2^20th of all words, so that a document's picks
stay few. Sources whose target is less than BLOCKS_A_SOURCE such blocks take
no part in that: they get whole passes and the first words of their stream,
up to their target rounded to a whole word, each pass in a shard by a hash.

Positions in a stream come from two prefix sums, one over a bounded number
of hash ranges per source and one in each range, so no task sees a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import WORD_GAP, checkpoint, n_words

WEIGHTS = (5, 2, 1)
CAP = 3
MAX_BLOCKS = 1 << 20
MAX_RANGES = 1 << 20
DOCS_A_RANGE = 64
BLOCKS_A_SOURCE = 200
SHARDS = 16
STEP = 2147483647


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, weight, target from (source, source_size).

    Sources by code point, null last, take the weights in turn. A target
    stops at cap times its source's size; the excess is shared again by
    weight until none is above. Ordered by size over weight, the stopped
    sources come first, so the level follows from prefix sums. One row per
    source meets in one task here.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = sizes.withColumn("_i", (F.row_number().over(order) - 1) % len(weights))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("_i") + 1).cast("long"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    ranked = ranked.select(
        "source",
        "source_size",
        "weight",
        total.alias("_total"),
        (total - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("_rest"),
        F.sum("weight").over(after).alias("_weights"),
    )
    # A source is stopped if its cap is at most the level that it and those after it would get.
    free = F.col("source_size") * cap * F.col("_weights") > F.col("_rest") * F.col("weight")
    level = F.struct("_rest", "_weights")
    ranked = ranked.withColumn("_free", free).withColumn(
        "_level", F.max(F.when(free, level)).over(Window.partitionBy(F.lit(0)))
    )
    share = F.col("_level._rest").cast("double") / F.col("_level._weights").cast("double") * F.col("weight")
    target = F.when(F.col("_free"), share).otherwise((F.col("source_size") * cap).cast("double"))
    return ranked.select("source", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


def shard_quotas(targets: DataFrame, block: int, n_shards: int = 1, words: float | None = None) -> DataFrame:
    """(source, shard, quota): whole blocks of each source in each shard, by highest quotient.

    The blocks hold as many words as the sources, or words if given.

    Shard i closes a house of i / n_shards of all blocks. A source's seats
    differ from its exact share by at most half the number of sources times
    that share, so only quotients near it are compared; those before them
    win in any case.
    """
    every = Window.partitionBy(F.lit(0))
    base = targets.where("target > 0").select(
        "source",
        "target",
        F.sum("target").over(every).alias("_sum"),
        (F.sum("source_size").over(every) if words is None else F.lit(words)).alias("_t"),
        F.count(F.lit(1)).over(every).alias("_n"),
    )
    # Apart from the sums above, which would else count each source once a shard.
    base = base.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(n_shards))))
    base = base.withColumn("_seats", F.round(F.col("_t") / block * F.col("shard") / n_shards).cast("long"))
    exact = F.col("target") / F.col("_sum") * F.col("_seats")
    slack = F.ceil(F.col("target") / F.col("_sum") * F.col("_n") / 2) + 2
    base = base.withColumn("_sure", F.greatest(F.floor(exact) - slack, F.lit(0)).cast("long")).withColumn(
        "_last", (F.ceil(exact) + slack).cast("long")
    )
    open_seats = F.col("_seats") - F.sum("_sure").over(Window.partitionBy("shard"))
    near = base.withColumn("_open", open_seats).withColumn("_k", F.explode(F.sequence("_sure", "_last")))
    near = near.withColumn("_quotient", F.col("target") / (2 * F.col("_k") + 1))
    by_quotient = Window.partitionBy("shard").orderBy(
        F.col("_quotient").desc(), F.col("source").isNull(), F.col("source").cast("binary"), "_k"
    )
    won = near.withColumn("_won", (F.row_number().over(by_quotient) <= F.col("_open")).cast("long"))
    won = won.groupBy("source", "shard").agg((F.first("_sure") + F.sum("_won")).alias("n"))
    # Divisor methods never take a seat back from anyone when the house grows.
    upto = Window.partitionBy("source").orderBy("shard")
    return won.select("source", "shard", (F.col("n") - F.coalesce(F.lag("n").over(upto), F.lit(0))).alias("quota"))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, cap=CAP, seed=17, n_shards=SHARDS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, n_passes, ranges, pieces.

    size counts words, 0 for a null or empty text. pieces has the document's
    part of each block that a seat took: the seat's shard from 0 and [from,
    to) word positions; taken is their sum in words. Put together, they are
    n_passes whole copies of the document and once more its words in ranges.
    A source of size 0 has target 0. Ties in the seeded order go by id and size; rows
    that repeat an id and a size are interchangeable. An empty table gives
    no rows. The same rows give the same result whatever their partitioning.
    """
    found = _mixed(docs, id_col, text_col, source_col, weights, cap, seed, n_shards)
    return found.select("doc_id", "size", "source_size", "target", "taken", "n_passes", "ranges", "pieces")


def _mixed(docs: DataFrame, id_col, text_col, source_col, weights=WEIGHTS, cap=CAP, seed=17, n_shards=SHARDS, carry: bool = False) -> DataFrame:
    """The columns of mix, and if carry is set each row of docs itself as _doc, with the plan of its own."""
    # An id's place in its source's stream is its md5, read as a number for the range and as text in it.
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(docs[id_col].cast("string"), F.lit(""))))
    columns = [
        docs[id_col].cast("long").alias("doc_id"),
        docs[source_col].cast("string").alias("source"),
        n_words(docs[text_col]).alias("size"),
        order.alias("_order"),
    ]
    rows = checkpoint(docs.select(*columns))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n"))
    targets = checkpoint(source_targets(sizes, weights, cap))
    shape = targets.where("target > 0").agg(F.sum("source_size"), F.min("target")).first()
    total, least = (shape[0] or 0), (shape[1] or 0.0)
    block = max(1, int(least // BLOCKS_A_SOURCE), -(-total // MAX_BLOCKS))
    # None is below that where the smallest target alone sets the block; a block of one word is exact as it is.
    small = (F.col("target") > 0) & (F.col("target") < BLOCKS_A_SOURCE * block) if block > 1 else F.lit(False)
    goal = F.when(small, F.round("target").cast("long")).otherwise(0)
    targets = targets.withColumn("_small", small).withColumn("_goal", goal)
    apart = targets.where("_small").agg(F.sum("target")).first()[0] or 0
    quotas = shard_quotas(targets.where("NOT _small"), block, n_shards, words=total - apart).groupBy(F.col("source").alias("_of")).agg(
        F.sum("quota").alias("_quota"), F.sort_array(F.collect_list(F.struct("shard", "quota")))["quota"].alias("_quotas")
    )
    plan = targets.join(quotas, F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of")
    # The seat at which each shard ends.
    plan = plan.withColumn("_ends", F.transform("_quotas", lambda _, i: F.aggregate(F.slice("_quotas", 1, i + 1), F.lit(0).cast("long"), lambda s, q: s + q)))
    plan = plan.drop("_quotas").withColumn("_quota", F.coalesce("_quota", F.lit(0))).withColumn(
        "_blocks", F.ceil(F.col("source_size") / block).cast("long")
    )
    plan = plan.withColumn("n_passes", F.least(F.expr("_quota div greatest(_blocks, 1)"), F.lit(cap)).cast("long"))
    plan = plan.withColumn("_picks", F.when(F.col("n_passes") < cap, F.col("_quota") - F.col("n_passes") * F.col("_blocks")).otherwise(0))
    passes = F.least(F.expr("_goal div greatest(source_size, 1)"), F.lit(cap)).cast("long")
    plan = plan.withColumn("n_passes", F.when(F.col("_small"), passes).otherwise(F.col("n_passes")))
    plan = plan.withColumn("_head", F.when(F.col("_small") & (F.col("n_passes") < cap), F.col("_goal") - F.col("n_passes") * F.col("source_size")).otherwise(0))
    plan = checkpoint(plan)

    n_ranges = max(1, min(MAX_RANGES, rows.count() // DOCS_A_RANGE))
    lead = F.conv(F.substring("_order", 1, 8), 16, 10).cast("long")
    in_range = F.shiftright(lead * n_ranges, 32)
    rows = rows.withColumn("_range", in_range)
    ranges = rows.groupBy("source", "_range").agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("source", "_range", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_start"))
    own = ["_order", "doc_id", "size"]
    if carry:
        # The text moves once, here; rows that repeat an id and a size go by a hash of it.
        rows = docs.select(*columns, F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), F.xxhash64(docs[text_col]).alias("_tie"))
        rows = rows.withColumn("_range", in_range)
        own = [*own, "_tie"]
    inside = Window.partitionBy("source", "_range").orderBy(*own)
    placed = rows.withColumn("_in", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.join(
        ranges, placed["source"].eqNullSafe(ranges["source"]) & (placed["_range"] == ranges["_range"])
    ).select("doc_id", placed["source"], "size", *(["_doc"] if carry else []), (F.col("_start") + F.col("_in")).alias("_a"))
    own_plan = plan.withColumnRenamed("source", "_source")
    own_plan = F.broadcast(own_plan) if plan.count() <= 10_000 else own_plan
    found = placed.join(own_plan, placed["source"].eqNullSafe(F.col("_source"))).drop("source")

    a, b = F.col("_a"), F.col("_a") + F.col("size")
    seated = (F.col("size") > 0) & (F.col("_quota") > 0)
    touched = F.when(seated, F.sequence(F.floor(a / block).cast("long"), F.floor((b - 1) / block).cast("long")))
    touched = F.coalesce(touched, F.array().cast("array<bigint>"))
    found = found.withColumn(
        "_touched",
        F.transform(
            touched,
            lambda j: F.struct(
                ((j * STEP + seed) % F.col("_blocks")).alias("rank"),
                (F.greatest(a, j * block) - a).alias("from"),
                (F.least(b, (j + 1) * block) - a).alias("to"),
            ),
        ),
    )
    spans = F.transform(F.filter("_touched", lambda t: t["rank"] < F.col("_picks")), lambda t: F.struct(t["from"].alias("from"), t["to"].alias("to")))
    head = F.array(F.struct(F.lit(0).cast("long").alias("from"), (F.least(b, F.col("_head")) - a).alias("to")))
    in_head = (F.col("size") > 0) & (a < F.col("_head"))
    found = found.withColumn("ranges", F.when(in_head, head).otherwise(spans))

    def seats(t):
        """The pieces of a touched part: one for each pass, and one more if it was picked."""
        last = F.col("n_passes") + (t["rank"] < F.col("_picks")).cast("long") - 1
        passes = F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<bigint>"))
        shard = lambda p: F.size(F.filter("_ends", lambda e: e <= p * F.col("_blocks") + t["rank"]))
        return F.transform(passes, lambda p: F.struct(shard(p).alias("shard"), t["from"].alias("from"), t["to"].alias("to")))

    def apart_in(p):
        return F.pmod(F.xxhash64(F.lit(seed), F.coalesce("_source", F.lit("")), p), F.lit(n_shards)).cast("int")

    whole = F.when((F.col("n_passes") > 0) & (F.col("size") > 0), F.sequence(F.lit(1).cast("long"), F.col("n_passes")))
    whole = F.transform(F.coalesce(whole, F.array().cast("array<bigint>")), lambda p: F.struct(apart_in(p).alias("shard"), F.lit(0).cast("long").alias("from"), F.col("size").alias("to")))
    heads = F.transform("ranges", lambda r: F.struct(apart_in(F.lit(0).cast("long")).alias("shard"), r["from"].alias("from"), r["to"].alias("to")))
    pieces = F.when(F.col("_small"), F.concat(whole, heads)).otherwise(F.flatten(F.transform("_touched", seats)))
    found = found.withColumn("pieces", pieces)
    return found.withColumn("taken", F.aggregate("pieces", F.lit(0).cast("long"), lambda s, r: s + r["to"] - r["from"]))


def mixed_documents(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", **options) -> DataFrame:
    """The rows of the mix with the columns of docs: whole copies, and one row of a document's picked words.

    Each row follows a plan of its own, also where ids repeat or are null; a
    document that the mix takes no word of has no row.
    """
    found = _mixed(docs, id_col, text_col, source_col, carry=True, **options).where("taken > 0").select("_doc", "n_passes", "ranges")
    text = F.col("_doc")[text_col]
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    found = found.withColumn("_words", F.when(F.size("ranges") > 0, words))
    parts = F.flatten(F.transform("ranges", lambda r: F.slice("_words", r["from"] + 1, r["to"] - r["from"])))
    copies = F.array_repeat(text, F.col("n_passes").cast("int"))
    texts = F.when(F.size("ranges") > 0, F.concat(copies, F.array(F.array_join(parts, " ")))).otherwise(copies)
    return found.withColumn("_mixed", F.explode(texts)).select(
        *[F.col("_mixed").alias(c) if c == text_col else F.col("_doc")[c].alias(c) for c in docs.columns]
    )
