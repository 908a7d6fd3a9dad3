"""Near-duplicates by b-bit MinHash.

Each text's set of word shingles is reduced to minima under seeded
permutations. Bands of minima give candidate pairs; of the minima only the
low BITS are kept, packed into longs. Matching fields of two signatures,
counted by bit counts and corrected for chance collisions, estimate the
similarity; pairs well below the threshold go. The rest are confirmed on
the full sets.

Texts of equal sets form a class and take part as one. Members of a band's
bucket meet its two centres first, which joins most of a large group. The
buckets that this leaves in several components are settled without pairing
their members: the shingles of those texts are ordered from the rarest on,
and two sets of the threshold's similarity share one of the first few
(prefix filtering), so only texts that share such a rare shingle meet.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import checkpoint, map_texts, pick
from tidelog.llm.links import BROADCAST_IDS, across, components, counted, divided, in_company, joined, only, star_pairs

BITS = 4
MISS = 1e-6
MAX_MINIMA = 200
#: Standard errors below the threshold at which an estimate still counts.
MARGIN = 4.75
#: Words whose hashes a worker remembers.
WORDS_KEPT = 30_000
CHUNK = 1024
#: Sizes of sets are told apart in steps of this ratio by the prefix filter.
STEP = 1.05

_words: dict[bytes, int] = {}


def bands_for(percent: int) -> tuple[int, int]:
    """(bands, rows): most rows a band of at most MAX_MINIMA minima that lose a pair at the threshold once in 1 / MISS."""
    best = None
    for rows in range(1, 40):
        bands = math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** rows))) if percent < 100 else 1
        if bands * rows <= MAX_MINIMA:
            best = bands, rows
    return best


def words(text: str | None) -> list[bytes]:
    """Words of a text, A to Z in lower case; bytes methods know only ASCII."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _hashes(found: list[bytes]) -> np.ndarray:
    try:
        out = [_words[w] for w in found]
    except KeyError:
        if len(_words) > WORDS_KEPT:
            _words.clear()
        out = []
        for w in found:
            h = _words.get(w)
            if h is None:
                h = _words[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
    return np.array(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; the whole sequence is one where there are fewer words."""
    found = words(text)
    if not found:
        return np.zeros(0, dtype=np.uint64)
    h = _hashes(found)
    span = min(width, len(h))
    out = np.full(len(h) - span + 1, span, dtype=np.uint64)
    for i in range(span):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - span + 1 + i]
    return np.unique(_mixed(out))


@lru_cache(maxsize=8)
def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20_240_501)
    return (
        (draw.integers(0, 1 << 32, n, dtype=np.uint64) | np.uint64(1)).astype(np.uint32),
        draw.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32),
    )


def minima(found: np.ndarray, n: int) -> np.ndarray:
    """Minima of a set under n permutations of 32-bit values."""
    times, plus = permutations(n)
    low = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    values = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(values), CHUNK):
        part = values[at : at + CHUNK, None] * times
        part += plus
        np.minimum(low, part.min(axis=0), out=low)
    return low


def packed(low: np.ndarray) -> np.ndarray:
    """The low BITS of each minimum, 64 / BITS of them in a long."""
    fields = 64 // BITS
    low = np.concatenate([low, np.zeros(-len(low) % fields, dtype=low.dtype)]).astype(np.uint64) & np.uint64((1 << BITS) - 1)
    shifts = (np.arange(fields, dtype=np.uint64) * np.uint64(BITS))[None, :]
    return np.bitwise_or.reduce(low.reshape(-1, fields) << shifts, axis=1).view(np.int64)


def band_keys(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for column in low.reshape(bands, rows).T.astype(np.uint64):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


def sketches(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, key, signature, bands) of each document, in one pass over the texts."""
    bands, rows = bands_for(percent)

    def work(doc_id, text):
        sets = [shingles(t, width) for t in text]
        low = [minima(s, bands * rows) for s in sets]
        return {
            "doc_id": doc_id,
            "n_shingles": [len(s) for s in sets],
            "key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
            "signature": [packed(x) for x in low],
            "bands": [band_keys(x, bands, rows) for x in low],
        }

    schema = {
        "doc_id": ("long", pa.int64()),
        "n_shingles": ("long", pa.int64()),
        "key": ("binary", pa.binary()),
        "signature": ("array<long>", pa.list_(pa.int64())),
        "bands": ("array<long>", pa.list_(pa.int64())),
    }
    return map_texts(docs, ["doc_id", "text"], work, schema)


def estimate(left: Column, right: Column, n: int) -> Column:
    """Similarity from two packed signatures of n fields: share of equal fields less that of chance."""
    fields = int("1" * (64 // BITS), 2 ** BITS) if BITS > 1 else -1

    def differing(x, y):
        z = x.bitwiseXOR(y)
        for shift in (1, 2):
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
        return F.bit_count(z.bitwiseAND(F.lit(fields).cast("long")))

    differ = F.aggregate(F.zip_with(left, right, differing), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    return (1 - differ / n - chance) / (1 - chance)


def least_estimate(percent: int, n: int) -> float:
    chance = 2.0**-BITS
    equal = chance + percent / 100 * (1 - chance)
    return percent / 100 - MARGIN * math.sqrt(equal * (1 - equal) / n) / (1 - chance)


def shingle_sets(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of classes(id, key), read from docs; 48 bits of each shingle, sorted, in one binary."""

    def reduce(doc_id, text):
        sets = [shingles(t, width) for t in text]
        small = [np.unique(s >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for s in sets]
        return {"id": doc_id, "key": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "shingles": small}

    kinds = {"id": ("long", pa.int64()), "key": ("binary", pa.binary()), "shingles": ("binary", pa.binary())}
    sets = map_texts(only(docs, classes.select("id"), "doc_id"), ["doc_id", "text"], reduce, kinds)
    # Rows that repeat both id and set are one.
    return checkpoint(sets.join(classes.select("id", "key"), ["id", "key"], "left_semi").select("id", "shingles").dropDuplicates(["id"]))


def unpack(x: bytes) -> np.ndarray:
    wide = np.zeros((len(x) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(x, dtype=np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel()


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b) whose full sets have the similarity."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))

    def check(a, b, sa, sb):
        keep = []
        for i, (x, y) in enumerate(zip(sa, sb, strict=True)):
            short, long = sorted((len(x) // 6, len(y) // 6))
            if 100 * short < percent * long:
                continue
            same = len(np.intersect1d(unpack(x), unpack(y), assume_unique=True))
            if 100 * same >= percent * (short + long - same):
                keep.append(i)
        return {"a": [a[i] for i in keep], "b": [b[i] for i in keep]}

    both = pairs.join(left, "a").join(right, "b")
    return map_texts(both, ["a", "b", "sa", "sb"], check, {"a": ("long", pa.int64()), "b": ("long", pa.int64())})


def least_shared(n: Column, m: Column, percent: int) -> Column:
    """Fewest common shingles of sets of n and of m that have the similarity."""
    return F.ceil(percent * (n + m) / (100 + percent))


def rare_members(sets: DataFrame, percent: int) -> DataFrame:
    """(bucket, id, n, place, shorter): where sets of the similarity are sure to meet.

    Shingles go from the rarest among the sets on, place counts from 1; those
    of one set alone meet nobody and are left out. In its own step of sizes a
    set stands with the places at which it can meet another as long or
    longer, and in each step from its size down to the least that a partner
    has with those at which it can meet a shorter one.
    """
    schema = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("s", pa.list_(pa.int64()))])

    def spread(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                own = [unpack(x) for x in part.column(1).to_pylist()]
                ends = np.cumsum([0] + [len(x) for x in own])
                lists = pa.ListArray.from_arrays(ends.astype(np.int32), np.concatenate(own).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends).astype(np.int32)), lists], schema=schema)

    sets = sets.select("id", "shingles").mapInArrow(spread, "id long, n int, s array<long>")
    single = sets.select("id", "n", F.explode("s").alias("s"))
    often = checkpoint(single.groupBy("s").agg(F.count(F.lit(1)).alias("often")).where("often > 1"))
    shared = single.join(often, "s")
    listed = shared.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("often", "s"))).alias("rare"))
    n, m = F.col("n"), F.col("m")
    alone = n - F.size("rare")
    shortest = F.ceil(percent * n / 100).cast("int")
    deepest = n - least_shared(n, shortest, percent) + 1
    rows = listed.select("id", "n", alone.alias("alone"), F.posexplode(F.slice("rare", 1, F.greatest(deepest - alone, F.lit(0)))).alias("k", "r"))
    rows = rows.select("id", "n", (F.col("alone") + F.col("k") + 1).alias("place"), F.col("r.s").alias("s"))

    def step(size):
        return F.floor(F.log(size) / math.log(STEP)).cast("int")

    low = rows.where(F.col("place") <= n - least_shared(n, n, percent) + 1).select(
        F.xxhash64("s", step(n)).alias("bucket"), "id", "n", "place", F.lit(True).alias("shorter")
    )
    high = rows.withColumn("step", F.explode(F.sequence(step(shortest), step(n))))
    high = high.withColumn("m", F.greatest(shortest, F.floor(F.pow(F.lit(STEP), F.col("step")) - 1e-6)))
    high = high.where(F.col("place") <= n - least_shared(n, m, percent) + 1).select(
        F.xxhash64("s", "step").alias("bucket"), "id", "n", "place", F.lit(False).alias("shorter")
    )
    return in_turns(low.unionByName(high))


def in_turns(members: DataFrame) -> DataFrame:
    """members of the buckets where a shorter and a longer set can meet."""
    sizes = members.groupBy("bucket").agg(F.min("id").alias("i"), F.max("id").alias("j"), F.count_if("shorter").alias("low"), F.count_if(~F.col("shorter")).alias("high"))
    return checkpoint(members.join(checkpoint(sizes.where("i < j AND low > 0 AND high > 0").select("bucket")), "bucket"))


def link_sets(classes: DataFrame, source: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, component) of the linked ones of classes(id, key, n_shingles, signature, bands)."""
    bands, rows = bands_for(percent)
    floor = least_estimate(percent, bands * rows)
    live = in_company(classes.select("id", F.explode("bands").alias("bucket")))
    ids = checkpoint(live.select("id").distinct())
    sets = shingle_sets(source, checkpoint(classes.select("id", "key").join(ids, "id", "left_semi")), width)
    facts = ("n_shingles", "signature")
    left = classes.select(F.col("id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in facts])
    right = classes.select(F.col("id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in facts])

    def verify(pairs):
        near = pairs.join(left, "a").join(right, "b")
        short, long = F.least("n_shingles_a", "n_shingles_b"), F.greatest("n_shingles_a", "n_shingles_b")
        near = near.where((100 * short >= percent * long) & (estimate(F.col("signature_a"), F.col("signature_b"), bands * rows) >= floor))
        return checkpoint(confirm(checkpoint(near.select("a", "b")), sets, percent))

    linked = checkpoint(components(verify(counted(star_pairs(live)))))
    rest = checkpoint(divided(live.select("bucket", "id"), linked).select("id").distinct())
    tagged = divided(rare_members(only(sets, rest, "id"), percent), linked)

    def can_meet(x, y):
        """One is the shorter or as long with the smaller id, and both have enough left from their places on."""
        before = F.struct(x("n"), x("id")) < F.struct(y("n"), y("id"))
        turns = (x("shorter") & ~y("shorter") & before) | (~x("shorter") & y("shorter") & ~before)
        left = 1 + F.least(x("n") - x("place"), y("n") - y("place"))
        return turns & (left >= least_shared(x("n"), y("n"), percent))

    return joined(linked, verify(counted(across(tagged, can_meet))))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * shared >= percent * all of their
    distinct shingles of width words, A to Z in lower case; a text of fewer
    words is one shingle. A text without words, or null, has no shingle and
    no link. component_id is the smallest id that links reach, itself
    included; kept marks the rows that have it. A null id has no link and a
    null component, and its row is kept. Rows that repeat an id are one
    document. An empty table gives no rows.
    """
    source = pick(docs, id_col, text_col)
    bands, rows = bands_for(percent)
    found = checkpoint(sketches(source, width, percent))
    sets = found.where("key IS NOT NULL AND doc_id IS NOT NULL")
    reps = checkpoint(sets.groupBy("key").agg(F.min("doc_id").alias("rep")))
    # Where an id is the least of several sets, that of the least key takes part.
    own = reps.groupBy(F.col("rep").alias("id")).agg(F.min("key").alias("key"))
    classes = sets.join(own, (sets["key"] == own["key"]) & (sets["doc_id"] == own["id"])).drop(sets["key"])
    classes = checkpoint(classes.select("id", "key", "n_shingles", "signature", "bands").dropDuplicates(["id"]))
    linked = link_sets(classes, source, width, percent)
    placed = reps.join(linked, reps["rep"] == linked["id"], "left").select(
        reps["key"], F.coalesce("component", "rep").alias("component_id")
    )
    out = found.select("doc_id", "n_shingles", "key").join(placed, "key", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those of whose group a smaller id stays; all columns unchanged, null ids stay."""
    found = near_duplicates(docs, width, percent, id_col, text_col)
    gone = checkpoint(found.where("NOT kept").select(F.col("doc_id").alias("id")).distinct())
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(side, docs[id_col] == side["id"], "left_anti")
