"""Order over whole columns, without a task that sees them whole.

Values are dealt to CELLS cells by cut points of a mergeable sketch. Which cell
a value is in and how much lies in the cells before are known exactly, so
ranks need a window within each cell only, and a quantile needs only the cell
that holds its rank, cut again as long as it is large.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.storage import settled

#: Cells of a pass: 16 of 16, so that a value's cell takes 30 comparisons.
STEP = 16
CELLS = STEP * STEP
#: Rows that one task may order; cells with more are cut again, at most LEVELS times.
MOST = 1 << 20
LEVELS = 4


def _cuts(value: Column) -> Column:
    """CELLS - 1 ascending values that cut a group into about equal parts."""
    return F.percentile_approx(value, [i / CELLS for i in range(1, CELLS)], 10_000)


def _in_cells(df: DataFrame, value: str, cuts: str) -> DataFrame:
    """df with _cell, the number of cuts below the value; rises with the value."""
    over = lambda at: (F.col(value) > F.get(cuts, at)).cast("int")
    df = df.withColumn("_coarse", sum((over(F.lit(STEP * i - 1)) for i in range(1, STEP)), F.lit(0)))
    fine = sum((over(F.col("_coarse") * STEP + k) for k in range(STEP - 1)), F.lit(0))
    return df.withColumn("_cell", F.col("_coarse") * STEP + fine).drop("_coarse", cuts)


def running(df: DataFrame, value: str, sums: Iterable[str]) -> DataFrame:
    """df, of one row a value, with <name>_before, the sum over all smaller values, and <name>_all for each name of sums.

    Null values are left out. df is computed once.
    """
    sums = list(sums)
    df = settled(df.where(F.col(value).isNotNull()))
    rows = _in_cells(df.join(F.broadcast(df.agg(_cuts(F.col(value)).alias("_cuts")))), value, "_cuts")
    # At most CELLS rows, so that each can meet all before it.
    cells = rows.groupBy("_cell").agg(*[F.sum(c).alias(c) for c in sums])
    earlier = cells.select(F.col("_cell").alias("_c"), *[F.col(c).alias(f"_{c}") for c in sums])
    before = cells.select("_cell").join(F.broadcast(earlier), F.col("_c") < F.col("_cell"), "left").groupBy("_cell")
    before = before.agg(*[F.coalesce(F.sum(f"_{c}"), F.lit(0)).alias(f"_{c}") for c in sums])
    whole = cells.agg(*[F.sum(c).alias(f"{c}_all") for c in sums])
    within = Window.partitionBy("_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(F.broadcast(before), "_cell").join(F.broadcast(whole))
    found = {f"{c}_before": F.col(f"_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums}
    return rows.withColumns(found).drop("_cell", *[f"_{c}" for c in sums])


def places(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value, place): the place of each different value among those of its group, from 1; nulls are left out.

    Pairs are dealt to ranges of (by, value), so that a large group lies in
    many. A pair's place is that within its range and group, moved by how many the group
    has in the ranges before.
    """
    pairs = df.select(by, value).where(F.col(by).isNotNull() & F.col(value).isNotNull()).distinct()
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written with the number of the range, since a range dealt anew may have other bounds.
    rows = settled(pairs.repartitionByRange(ranges, by, value).withColumn("_range", F.spark_partition_id()))
    sizes = rows.groupBy(by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(by, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(by, "_range").orderBy(value))
    return rows.withColumn("_own", own).join(sizes, [by, "_range"]).select(by, value, (F.col("_before") + F.col("_own")).alias("place"))


def rank_percent(df: DataFrame, value: str, out: str) -> DataFrame:
    """df with the average rank of each value as a part of all rows; null for null.

    Only distinct values with their counts are ranked.
    """
    counts = running(df.groupBy(value).agg(F.count(F.lit(1)).alias("_n")), value, ["_n"])
    place = (F.col("_n_before") + (F.col("_n") + 1) / 2) / F.col("_n_all")
    return df.join(counts.select(value, place.alias(out)), value, "left")


def exact_quantiles(df: DataFrame, value: str, probabilities: list[float], by: Iterable[str] = (), most: int = MOST) -> DataFrame:
    """(by..., q): an array of the exact quantiles of each group, linear between neighbours, as percentile gives them.

    Null values don't count, NaN is above all numbers, and a group without
    values has no row. Cells of more than most rows that hold a wanted rank
    are cut again; rows outside such cells aren't shuffled. df is read several
    times, so one that is costly to compute is best settled before.
    """
    by = list(by)
    key = F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(c) for c in by])) if by else F.lit("")
    rows = df.select(key.alias("_k"), F.lit(0).cast("long").alias("_c"), F.col(value).cast("double").alias("_v"), *by).where("_v IS NOT NULL")
    groups = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in by])
    wanted = groups.select("*", F.posexplode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("_i", "_p"))
    wanted = wanted.withColumn("_at", F.col("_p") * (F.col("_n") - 1))
    wanted = wanted.withColumn("_low", F.floor("_at")).withColumn("_high", F.ceil("_at"))
    # _r is the rank in the group, _in the rank in the cell; _c numbers the cell.
    targets = wanted.select("_k", F.lit(0).cast("long").alias("_c"), F.explode(F.array("_low", "_high")).alias("_r")).distinct()
    targets = targets.withColumn("_in", F.col("_r"))
    live = rows.select("_k", "_c", "_v")
    for _ in range(LEVELS):
        largest = live.groupBy("_k", "_c").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        if largest is None or largest <= most:
            break
        cuts = live.groupBy("_k", "_c").agg(_cuts(F.when(~F.isnan("_v"), F.col("_v"))).alias("_cuts"))
        marked = _in_cells(live.join(cuts, ["_k", "_c"]), "_v", "_cuts").withColumn("_cell", F.col("_c") * CELLS + F.coalesce("_cell", F.lit(0)))
        sizes = marked.groupBy("_k", "_c", "_cell").agg(F.count(F.lit(1)).alias("_n"))
        earlier = Window.partitionBy("_k", "_c").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.withColumn("_below", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        hit = targets.join(sizes, ["_k", "_c"]).where((F.col("_in") >= F.col("_below")) & (F.col("_in") < F.col("_below") + F.col("_n")))
        targets = settled(hit.select("_k", F.col("_cell").alias("_c"), "_r", (F.col("_in") - F.col("_below")).alias("_in")))
        live = marked.select("_k", F.col("_cell").alias("_c"), "_v").join(targets.select("_k", "_c").distinct(), ["_k", "_c"], "left_semi")
        live = settled(live)
    counts = live.groupBy("_k", "_c", "_v").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_k", "_c").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    found = targets.join(counts, ["_k", "_c"]).where((F.col("_in") < F.col("_upto")) & (F.col("_in") >= F.col("_upto") - F.col("_n")))
    low = found.select("_k", F.col("_r").alias("_low"), F.col("_v").alias("_a"))
    high = found.select("_k", F.col("_r").alias("_high"), F.col("_v").alias("_b"))
    both = wanted.join(low, ["_k", "_low"]).join(high, ["_k", "_high"])
    between = (F.col("_high") - F.col("_at")) * F.col("_a") + (F.col("_at") - F.col("_low")) * F.col("_b")
    both = both.withColumn("_q", F.when((F.col("_low") == F.col("_high")) | (F.col("_a") == F.col("_b")), F.col("_a")).otherwise(between))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda x: x["_q"])
    return both.groupBy("_k").agg(*[F.first(c).alias(c) for c in by], listed.alias("q")).drop("_k")


def quantiles_of(df: DataFrame, wanted: Mapping[str, list[float]], most: int = MOST) -> dict[str, list[float | None]]:
    """Exact quantiles of columns over all rows, a list each; None for columns without values."""
    every = sorted({p for ps in wanted.values() for p in ps})
    names = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in wanted]))
    found = {r["name"]: r["q"] for r in exact_quantiles(df.select(names.alias("f")).select("f.*"), "x", every, ["name"], most).collect()}
    return {c: [found[c][every.index(p)] if c in found else None for p in ps] for c, ps in wanted.items()}
