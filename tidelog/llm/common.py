"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space (space and 0x09 to 0x0D).
WORD_GAP = r"[\x20\x09-\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir; on a local master without it, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidelog-checkpoint-")
    sc.setCheckpointDir(folder)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a reliable checkpoint, computed once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def pick(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator reads, so that other columns can't clash with its own."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, WORD_GAP), lambda w: w != "")), F.lit(0)).cast("long")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows that a Python task handles at once; keeps its memory to a few texts.
SLICE = 64


def map_texts(df: DataFrame, columns: list[str], work, schema: dict[str, tuple[str, object]]) -> DataFrame:
    """Apply work to lists of the columns, a few rows at a time, on Arrow batches.

    work(*lists) returns a dict of lists or arrays. schema maps each name to
    its Spark and its Arrow type.
    """
    import pyarrow as pa

    out = pa.schema([(name, kind) for name, (_, kind) in schema.items()])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield pa.RecordBatch.from_pydict(work(*(c.to_pylist() for c in part.columns)), schema=out)

    return df.select(*columns).mapInArrow(run, ", ".join(f"{name} {kind}" for name, (kind, _) in schema.items()))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name below the checkpoint folder, which the driver and all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that holds it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
