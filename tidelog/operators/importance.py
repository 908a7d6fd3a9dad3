"""What a classifier's columns are worth: importances of a surrogate forest, and by permutation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.models import numeric
from tidelog.storage import settled

LOC = "geo_location"
#: Cells by which hashes, and scores, are ranked: only rows of one cell are ordered in one task.
CELLS = 1024


def areas(scored: DataFrame, key: str, score: str, positive: str) -> DataFrame:
    """(key, auc): the area under the curve of each key by rank sums, equal scores counted half; scores are 0 to 1.

    Null where a key has no positive or no negative rows.
    """
    cell = F.least(F.floor(F.col(score) * CELLS), F.lit(CELLS - 1))
    kinds = scored.groupBy(key, cell.alias("_cell"), F.col(score).alias("_s")).agg(
        F.count_if(F.col(positive)).alias("_p"), F.count_if(~F.col(positive)).alias("_n")
    )
    cells = kinds.groupBy(key, "_cell").agg(F.sum("_n").alias("_c"))
    before = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    within = Window.partitionBy(key, "_cell").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_before") + F.coalesce(F.sum("_n").over(within), F.lit(0)) + F.col("_n") / 2
    rows = kinds.join(cells, [key, "_cell"]).withColumn("_below", below)
    area = F.try_divide(F.sum(F.col("_p") * F.col("_below")), F.sum("_p") * F.sum("_n"))
    return rows.groupBy(key).agg(area.alias("auc"))


def shuffled(values: DataFrame, key: str, value: str, seed: int) -> DataFrame:
    """(key, geo_location, value): within each key the values of its rows, dealt anew.

    Two hashes order the rows of a key; a row gets the value of the one that
    has its place in the other order. Places are counted cell by cell of the
    hashes' highest bits.
    """

    def places(side: int, *columns: str) -> DataFrame:
        rows = values.select(key, *columns, F.xxhash64(F.lit(seed + side), key, LOC).alias("_h"), F.col(LOC).alias("_tie"))
        rows = rows.withColumn("_cell", F.shiftright("_h", 64 - CELLS.bit_length() + 1))
        sizes = rows.groupBy(key, "_cell").agg(F.count(F.lit(1)).alias("_n"))
        before = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.select(key, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        own = F.row_number().over(Window.partitionBy(key, "_cell").orderBy("_h", "_tie"))
        return rows.join(sizes, [key, "_cell"]).select(key, *columns, (F.col("_before") + own).alias("_place"))

    return places(0, LOC).join(places(1, value), [key, "_place"]).select(key, LOC, value)


def _forest(rows: DataFrame, trees: int, depth: int, seed: int):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = rows.select(array_to_vector("x").alias("_x"), F.col("y").cast("double").alias("_y"))
    return RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def _rows(df: DataFrame, columns: list[str], label: Column | str) -> DataFrame:
    own = F.col(label) if isinstance(label, str) else label
    return settled(numeric(df.withColumn("y", own.cast("boolean")), columns).select(LOC, "y", F.array(*columns).alias("x")).where("y IS NOT NULL"))


def surrogate(df: DataFrame, columns: list[str], label: Column | str = "is_bot", trees: int = 100, depth: int = 10, seed: int = 42) -> dict[str, float]:
    """Importance of each column in a random forest for a flag, the greatest first."""
    found = _forest(_rows(df, columns, label), trees, depth, seed).featureImportances.toArray()
    return dict(sorted(zip(columns, map(float, found), strict=True), key=lambda x: (-x[1], x[0])))


def _dealt(rows: DataFrame, rounds: int, seed: int) -> DataFrame:
    """(r, geo_location, y, x, other): each row once a round, other being x of the row it is dealt; only names are dealt."""
    names = rows.select(F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("r"), LOC, F.col(LOC).alias("_from"))
    others = rows.select(F.col(LOC).alias("_from"), F.col("x").alias("other"))
    # As many parts as the session asks for: each row is scored once a column, which its bytes don't tell.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shuffled(names, "r", "_from", seed).join(others, "_from").drop("_from")
    return rows.join(dealt.repartition(parts, LOC), LOC)


def by_permutation(
    df: DataFrame, columns: list[str], label: Column | str = "is_bot", rounds: int = 5, trees: int = 100, depth: int = 10, seed: int = 42
) -> DataFrame:
    """(feature, importance): how much of the area under the curve a forest for a flag loses when a column is shuffled.

    Rows are dealt anew once a round, for all columns, so that what is shuffled
    grows with rows and rounds only; where a row meets its other one, each
    column is a copy with one value replaced. All copies are scored in one
    pass and meet in one aggregate. The importance is the mean over rounds.
    With one class only it is 0.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = _rows(df, columns, label)
    if rows.select("y").distinct().count() < 2:
        return rows.sparkSession.createDataFrame([(c, 0.0) for c in columns], "feature string, importance double")
    model = _forest(rows, trees, depth, seed)
    # Copy 0 is unchanged; copy 1 + c * rounds + r has column c shuffled for the r-th time.
    changed = _dealt(rows, rounds, seed).select("r", "y", "x", "other", F.explode(F.sequence(F.lit(0), F.lit(len(columns) - 1))).alias("c"))
    swapped = F.transform("x", lambda e, i: F.when(i == F.col("c"), F.get("other", i)).otherwise(e))
    changed = changed.select((1 + F.col("c") * rounds + F.col("r")).alias("k"), "y", swapped.alias("x"))
    every = rows.select(F.lit(0).cast("int").alias("k"), "y", "x").unionByName(changed)
    scored = model.transform(every.select("k", "y", array_to_vector("x").alias("_x"))).select("k", "y", vector_to_array("probability")[1].alias("s"))
    found = settled(areas(scored, "k", "s", "y"))
    whole = found.where("k = 0").select(F.col("auc").alias("whole"))
    names = F.array(*[F.lit(c) for c in columns])
    losses = found.where("k > 0").join(F.broadcast(whole)).withColumn("feature", F.get(names, F.floor((F.col("k") - 1) / rounds).cast("int")))
    return losses.groupBy("feature").agg(F.avg(F.col("whole") - F.col("auc")).alias("importance"))
