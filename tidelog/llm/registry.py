"""Queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import language, pii, sql, toxicity
from tidelog.llm.bpe import round_trip
from tidelog.llm.centroids import clusters
from tidelog.llm.common import WORD_GAP, fold, read
from tidelog.llm.embedding_dedup import near_vectors
from tidelog.llm.exact_dedup import exact_dedup
from tidelog.llm.lattice_lm import lm_scores
from tidelog.llm.line_dedup import line_dedup
from tidelog.llm.minhash import near_duplicates
from tidelog.llm.mixing import mix
from tidelog.llm.repeats import periodic_runs
from tidelog.llm.secrets_scan import scan


def op1_minhash(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=85)


def op2_lm_scoring(spark, sf_dir):
    return lm_scores(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op4_line_dedup(spark, sf_dir):
    return line_dedup(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op5_mixing(spark, sf_dir):
    return mix(read(spark, sf_dir, "documents")).drop("ranges", "pieces")


def op6_bpe(spark, sf_dir):
    return round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_embedding_dedup(spark, sf_dir):
    return near_vectors(read(spark, sf_dir, "embeddings"))


def op8_secret_scan(spark, sf_dir):
    return scan(read(spark, sf_dir, "documents"))


def op9_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup(read(spark, sf_dir, "documents"))


def op11_centroids(spark, sf_dir):
    return clusters(read(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, scale=1024, seed=3)


def with_planted_runs(docs):
    """The documents' words, joined by one space, those of a tenth of them with a passage repeated to the end.

    Which, from where and how long the passage is follow from the crc32 of the id.
    """
    h, words = fold(F.col("doc_id"), 1 << 32), F.filter(F.split(F.coalesce("text", F.lit("")), WORD_GAP), lambda w: w != "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), h.alias("h"), words.alias("words")).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.coalesce(F.try_mod(F.floor(F.col("h") / 10), "n"), F.lit(0)).cast("int"))
    left = F.col("n") - F.col("a")
    rows = rows.withColumn("p", (1 + F.floor(left / (3 + F.floor(F.col("h") / 10) % 8))).cast("int"))
    passage = F.slice("words", F.col("a") + 1, F.col("p"))
    repeated = F.slice(F.flatten(F.array_repeat(passage, F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left)
    planted = F.concat(F.slice("words", F.lit(1), F.col("a")), repeated)
    return rows.select("doc_id", F.array_join(F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), planted).otherwise(F.col("words")), " ").alias("text"))


def op12_periodic_runs(spark, sf_dir):
    found = periodic_runs(with_planted_runs(read(spark, sf_dir, "documents")), least=6, factor=4)
    exponents = lambda a, b: (a["length"] * b["period"], b["length"] * a["period"])

    def before(a, b):
        mine, other = exponents(a, b)
        of_ties = F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise((a["period"] - b["period"]).cast("int"))
        return F.when(mine > other, -1).when(mine < other, 1).otherwise(of_ties)

    best = F.get(F.array_sort("runs", before), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_pii(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda name: F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *[number(k) for k in pii.KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def queries():
    return {
        "op1_minhash": op1_minhash,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_toxicity": op3_toxicity,
        "op4_line_dedup": op4_line_dedup,
        "op5_mixing": op5_mixing,
        "op6_bpe": op6_bpe,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_secret_scan": op8_secret_scan,
        "op9_language_id": op9_language_id,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_centroids": op11_centroids,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_pii": op13_pii,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {
        "op1_minhash": sql.MINHASH,
        "op4_line_dedup": sql.LINE_DEDUP,
        "op5_mixing": sql.MIXING,
        "op7_embedding_dedup": sql.EMBEDDING_DEDUP,
        "op10_exact_dedup": sql.EXACT_DEDUP,
        "op11_centroids": sql.centroids(),
        "op12_periodic_runs": sql.PERIODIC_RUNS,
    }
