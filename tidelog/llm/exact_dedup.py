"""Exact duplicates with a heavy-hitter split (DataFrame operations only).

A frequent-items sketch of the Misra-Gries family finds the digests that
may be frequent; one exact count verifies them. The verified winners, at
most ``k`` rows, are broadcast and settle their rows map-side. All other
digests go through an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import checkpoint, pick


def frequent_digests(rows: DataFrame, k: int = 1024, tracked: int = 8192, fan_in: int = 64) -> DataFrame:
    """At most k candidate digests with their estimated counts.

    Input partitions share fan_in sketches; a digest with more than about
    4 / tracked of all rows has at least that part of some sketch's rows, and
    is tracked there. Sketches merge by adding estimates per digest.
    """
    sketches = rows.groupBy((F.spark_partition_id() % fan_in).alias("_g")).agg(
        F.expr(f"approx_top_k(digest, {k}, {tracked})").alias("top")
    )
    top = sketches.select(F.explode("top").alias("top")).select(
        F.col("top.item").alias("digest"), F.col("top.count").alias("n")
    )
    found = top.groupBy("digest").agg(F.sum("n").alias("estimate"))
    return found.orderBy(F.col("estimate").desc(), "digest").limit(k)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 1024) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after no change; a null text counts as
    empty. Of equal texts the row with the largest id stays. A null id
    never wins over another id; where a group has only null ids, keep_id is
    null and its rows are kept. Rows that repeat an id and a text all count
    and carry the same result. An empty table gives no rows.
    """
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    rows = checkpoint(pick(docs, id_col, text_col).select("doc_id", digest.alias("digest")))
    candidates = checkpoint(frequent_digests(rows, k).where(F.col("estimate") > 1).select("digest"))
    stats = (F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    winners = checkpoint(rows.join(F.broadcast(candidates), "digest").groupBy("digest").agg(*stats))
    split = rows.join(F.broadcast(winners), "digest", "left")
    hot = split.where(F.col("group_size").isNotNull())
    cold = split.where(F.col("group_size").isNull()).select("doc_id", "digest")
    settled = cold.join(cold.groupBy("digest").agg(*stats), "digest")
    out = hot.select("doc_id", "digest", "keep_id", "group_size").unionByName(
        settled.select("doc_id", "digest", "keep_id", "group_size")
    )
    return out.select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
