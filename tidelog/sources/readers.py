"""Readers, writers and samples."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.storage import settled


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Dataset metadata from JSON: accession, title, submission and publication dates."""
    df = spark.read.schema("accession string, title string, submissionDate string, publicationDate string").json(path)
    return df.dropDuplicates(["accession"])


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Location labels from CSV or Parquet, with geo_location and final_label or is_bot."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True).drop_duplicates(["geo_location"])
    return spark.read.parquet(path)


def register(frames: dict[str, DataFrame]) -> None:
    """Make frames known to SQL by their names, as temporary views; earlier ones of those names are replaced."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def read_yaml(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as file:
        return yaml.safe_load(file) or {}


#: Signs of a hash by which rows are counted at once, and rows of a cell that are ordered.
SIGNS, CELL = 3, 100_000


def sample_exact(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """Exactly n rows (all where there are no more), those of lowest hash of their keys.

    Rows are counted by the first signs of their hashes, and those of the
    cell that holds the n-th again by more signs, until at most CELL rows are
    left in it. Whole cells below are taken by a filter; only in that one
    rows are ordered.
    """
    name = "_hash"
    while name in df.columns:
        name += "_"
    spread = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    rows, prefix, left = df.withColumn(name, spread), "", n
    while len(prefix) < 32:
        cells = rows.where(F.col(name).startswith(prefix)).groupBy(F.substring(name, 1, len(prefix) + SIGNS).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        # At most 16 ** SIGNS rows.
        for r in sorted(cells.collect(), key=lambda r: r["cell"]):
            if r["n"] > left:
                break
            left -= r["n"]
        else:
            # Only the first count can come to its end: no more than n rows in all.
            return df
        prefix = r["cell"]
        if r["n"] <= CELL:
            break
    last = rows.where(F.col(name).startswith(prefix)).orderBy(name, *keys).limit(left)
    return rows.where(F.col(name) < prefix).unionByName(last).drop(name)


def sample_share(df: DataFrame, share: float, seed: int = 42, most: int | None = None) -> DataFrame:
    out = df.sample(fraction=share, seed=seed)
    return out if most is None else out.limit(most)


def write_annotated(df: DataFrame, source: str, strategy: str = "new_file", target: str | None = None, sampled: bool = False) -> str | None:
    """Write an annotated log: new_file beside the source, overwrite in its place, or reports_only for nothing.

    A sampled log is never written over its source. new_file fails if its
    target exists. Overwriting goes through a folder beside the source, as
    Spark can't replace what it reads; the source is moved aside first and
    deleted last, so that a whole log exists at any time.
    """
    if strategy == "reports_only" or sampled:
        return None
    base = source.removesuffix("/").removesuffix(".parquet")
    beside = target or base + "_annotated.parquet"
    df.write.mode("overwrite" if strategy == "overwrite" else "error").option("compression", "snappy").parquet(beside)
    if strategy != "overwrite":
        return beside
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    old, new, aside = fs_path(source), fs_path(beside), fs_path(base + "_before.parquet")
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(aside):
        raise FileExistsError(f"{aside} is left from an overwrite that broke off")
    if not fs.rename(old, aside):
        raise OSError(f"could not move {source} aside")
    if not fs.rename(new, old):
        fs.rename(aside, old)
        raise OSError(f"could not move {beside} to {source}")
    fs.delete(aside, True)
    return source


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with nested columns as JSON text."""
    flat = [F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, header=True)


def write_json(values: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as file:
        json.dump(values, file, indent=2, default=str)


#: The column by which a kept log is partitioned.
YEAR = "log_year"


def keep_log(
    events: DataFrame, table: str, buckets: int = 64, location: str = "geo_location", at: str = "ts", path: str | None = None
) -> DataFrame:
    """Write canonical events as a table, partitioned by year and in buckets by location; the table.

    Profiles of the table need no shuffle of its events, as a location's rows
    are in one bucket. A row without a time stays, in a partition of its own. It
    lies in the warehouse, or at path. An existing table of that name is an error.
    """
    rows = events.withColumn(YEAR, F.year(at)).repartition(buckets, location)
    writer = rows.write.format("parquet").partitionBy(YEAR).bucketBy(buckets, location).sortBy(location)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return events.sparkSession.table(table)


def replace_years(events: DataFrame, table: str, buckets: int = 64, location: str = "geo_location", at: str = "ts") -> DataFrame:
    """Replace the years of a kept log that occur in events by their rows; other years stay as they are.

    Events may be derived from the table: what they read is settled before
    any of it is replaced.
    """
    spark = events.sparkSession
    old = spark.table(table)
    rows = settled(events.withColumn(YEAR, F.year(at)).select(*old.columns))
    name = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(name)
    spark.conf.set(name, "dynamic")
    try:
        rows.repartition(buckets, location).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(name, before)
    spark.catalog.refreshTable(table)
    return spark.table(table)
