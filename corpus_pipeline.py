"""From raw documents to token ids: a chain of corpus operators over Parquet tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import toxicity
from tidelog.llm.bpe import round_trip
from tidelog.llm.common import ensure_checkpoint_dir, read
from tidelog.llm.line_dedup import line_dedup
from tidelog.llm.minhash import without_near_duplicates
from tidelog.llm.mixing import mixed_documents


#: Words that a worker of the last stage remembers; the pipeline's executors hold the caches of all stages.
REMEMBERED = 40_000


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def _unused(names: list[str], name: str) -> str:
    """name, with underlines until no column has it in either case."""
    while name.lower() in {n.lower() for n in names}:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject.

    A null text and one without words stay. Repeated rows are judged
    one by one. All columns are kept; an empty table gives no rows.
    """
    return toxicity.without_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier document has; n_chars follows the text.

    Null texts stay null. Of rows that repeat id and text all but one lose
    their windows. All columns are kept; an empty table gives no rows.
    """
    return _measured(line_dedup(docs, counts=tuple(_unused(docs.columns, n) for n in ("n_lines", "n_removed"))), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more.

    The smallest id of a group stays. Texts without words and rows of null id
    stay; rows that repeat an id stay or go together. All columns are kept;
    an empty table gives no rows.
    """
    return without_near_duplicates(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, copies and parts of documents that the mix takes; n_chars follows the text.

    A text without words has no row. Repeated rows and null ids have plans of
    their own; a null source is a source. All columns are kept; an empty table
    gives no rows.
    """
    return _measured(mixed_documents(docs), docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each row; a null text counts as empty."""
    return round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True, remembered=REMEMBERED)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_lines),
    ("minhash", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: Toxicity has no SQL form.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that holds it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents, each written as Parquet in the shared folder and read again.

    What a stage read is deleted once its successor is written; the last
    stage's input stays, since the result is read from it.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{folder}/{i}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if i:
                _delete(spark, before)
            before = path
    return docs
