"""Models over the location profile.

Trees and networks are fitted in tasks, classifiers with Spark ML; scoring is
one pass over the profile, which has one row a location.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators import autoencoder, isolation
from tidelog.operators.order import quantiles_of, running
from tidelog.storage import settled

LOC = "geo_location"
#: Locations that a task scores on many trees, and seeds of a task on average in each round of boosting.
SCORED, BOOSTED = 1024, 1 << 14


def numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the columns as doubles; null, NaN and infinite values are 0."""
    sound = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    return df.withColumns({c: F.when(sound(c), F.col(c).cast("double")).otherwise(0.0) for c in columns})


def _isolated(df: DataFrame, columns: list[str], out: str, **forest) -> DataFrame:
    """(geo_location, out): isolation scores of all locations, computed once."""
    rows = settled(numeric(df.select(LOC, *columns), columns))
    found = isolation.fit(rows.select(LOC, F.array(*columns).alias("x")), **forest)
    # Few bytes, but much work a row: put together by bytes, one task would score all of a small profile.
    rows = rows.repartition(max(1, math.ceil(rows.count() / SCORED)))
    return settled(isolation.scores(rows, columns, found, out).select(LOC, out))


def add_anomaly(df: DataFrame, columns: list[str], contamination: float = 0.15, trees: int = 200, size: int = 256, seed: int = 42) -> DataFrame:
    """anomaly_score, above 0 for the most isolated part of all locations, and is_anomaly.

    Each tree sees size locations, drawn by hashes over all of them; the
    cut-off is an exact quantile over every location.
    """
    scored = _isolated(df, columns, "_s", trees=trees, size=size, seed=seed)
    ((offset,),) = quantiles_of(scored, {"_s": [1 - contamination]}).values()
    out = df.join(scored, LOC, "left").withColumn("anomaly_score", F.coalesce(F.col("_s") - F.lit(offset), F.lit(0.0))).drop("_s")
    return out.withColumn("is_anomaly", F.col("anomaly_score") > 0)


def add_isolation(
    df: DataFrame, columns: list[str], networks: int = 50, trees: int = 100, size: int = 256, seed: int = 7, out: str = "dif_score"
) -> DataFrame:
    """Isolation scores on random networks of the columns, trees for each of networks, brought to 0..1 over all locations."""
    scored = _isolated(df, columns, "_s", trees=networks * trees, size=size, networks=networks, seed=seed)
    ends = scored.agg(F.min("_s").alias("low"), F.max("_s").alias("high")).first()
    low, high = ends["low"] or 0.0, ends["high"] or 0.0
    return df.join(scored, LOC, "left").withColumn(out, F.coalesce((F.col("_s") - low) / max(high - low, 1e-10), F.lit(0.0))).drop("_s")


def add_reconstruction(df: DataFrame, columns: list[str], seed_column: str = "organic_seed", least: int = 30, epochs: int = 100) -> DataFrame:
    """vae_score, 0 to 1 by rank among the seeds' errors, and latents; zeros with too few seeds.

    The model learns what organic locations look like, so high errors mark others.
    """
    latents = [f"latent_{i}" for i in range(autoencoder.LATENTS)]
    rows = settled(numeric(df.select(LOC, seed_column, *columns), columns).select(LOC, F.array(*columns).alias("x"), F.col(seed_column).cast("double").alias("w")))
    seeds = rows.where("w IS NOT NULL")
    if seeds.count() < least:
        return df.withColumns({c: F.lit(0.0) for c in ["vae_score", *latents]})
    net = autoencoder.fit(seeds, epochs=epochs)
    found = settled(autoencoder.judged(rows, net).join(rows.select(LOC, F.col("w").isNotNull().cast("long").alias("seed")), LOC))
    places = running(found.groupBy("error").agg(F.sum("seed").alias("n")), "error", ["n"])
    places = places.select("error", (F.col("n_before") / F.col("n_all")).alias("vae_score"))
    found = found.join(places, "error").select(LOC, "vae_score", *[F.col("latents")[i].alias(c) for i, c in enumerate(latents)])
    return df.join(found, LOC, "left")


SEEDED = ("organic", "bot", "hub")


def _vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    """(geo_location, _x, seeds): the columns as one vector."""
    from pyspark.ml.feature import VectorAssembler

    seeds = [f"{k}_seed" for k in SEEDED]
    rows = VectorAssembler(inputCols=columns, outputCol="_x").transform(numeric(df, columns).select(LOC, *columns, *seeds))
    return settled(rows.select(LOC, "_x", *seeds))


def fit_fusion(rows: DataFrame, iterations: int = 200, depth: int = 5, seed: int = 42) -> dict[str, tuple | float]:
    """For each class a boosted classifier of the weighted seeds and the sigmoid on its margin, or a fixed probability.

    rows is what _vectors returns. A class without seeds has 0, the only one with seeds 1. The
    classes are fitted side by side, as none of them fills a cluster. Each level of a tree is a job, so
    seeds are dealt by their number, and in a fixed order, so that the draws don't depend on how rows came in.
    """
    from pyspark.ml.classification import GBTClassifier, LogisticRegression

    # A location that is a seed of two classes counts for each, as in a table of seeds.
    seeds = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"{k}_seed").alias("w")) for k in SEEDED]))
    train = rows.select(LOC, "_x", seeds.alias("s")).where("s.w IS NOT NULL").select(LOC, "_x", F.col("s.k").alias("k"), F.col("s.w").alias("w"))
    have = {r["k"]: r["count"] for r in train.groupBy("k").count().collect()}
    tasks = max(1, math.ceil(sum(have.values()) / BOOSTED))
    train = settled(train.repartition(tasks, LOC).sortWithinPartitions(LOC, "k").drop(LOC))

    def one(kind):
        own = train.withColumn("y", (F.col("k") == kind).cast("double"))
        gbt = GBTClassifier(
            featuresCol="_x", labelCol="y", weightCol="w", maxIter=iterations, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, minInstancesPerNode=10, seed=seed, predictionCol="_y"
        )
        gbt = gbt.setRawPredictionCol("_raw").setProbabilityCol("_p").fit(own)
        sigmoid = LogisticRegression(featuresCol="_raw", labelCol="y", weightCol="w", probabilityCol="_q", rawPredictionCol="_r2", predictionCol="_y2", regParam=1e-3)
        return gbt, sigmoid.fit(gbt.transform(own))

    if len(have) < 2:
        return {k: float(k in have) for k in SEEDED}
    with ThreadPoolExecutor(len(SEEDED)) as pool:
        return dict(zip(SEEDED, pool.map(lambda k: one(k) if k in have else 0.0, SEEDED), strict=True))


def fusion_importances(fitted: dict[str, tuple | float], columns: list[str]) -> dict[str, float]:
    """Importance of each column in the boosted classifiers, their mean over classes, the greatest first."""
    own = [m[0].featureImportances.toArray() for m in fitted.values() if isinstance(m, tuple)]
    mean = np.mean(own, axis=0) if own else np.zeros(len(columns))
    return dict(sorted(zip(columns, map(float, mean), strict=True), key=lambda x: (-x[1], x[0])))


def fuse(df: DataFrame, columns: list[str], iterations: int = 200, depth: int = 5, seed: int = 42) -> DataFrame:
    """prob_organic, prob_bot, prob_hub, predicted and classification_confidence.

    One boosted classifier a class learns from the weighted seeds, with a
    sigmoid on its margin; the three are scaled to one. A class without seeds,
    or with nothing to tell it from, has probability 0. Without any seeds all
    rows are organic with confidence 0.
    """
    from pyspark.ml.functions import vector_to_array

    kinds, rows = SEEDED, _vectors(df, columns)
    scored = rows.select(LOC, "_x")
    for kind, model in fit_fusion(rows, iterations, depth, seed).items():
        if isinstance(model, float):
            scored = scored.withColumn(f"prob_{kind}", F.lit(model))
            continue
        keep = [c for c in scored.columns]
        scored = model[1].transform(model[0].transform(scored)).select(*keep, vector_to_array("_q")[1].alias(f"prob_{kind}"))
    whole = sum((F.col(f"prob_{k}") for k in kinds), F.lit(0.0))
    scored = scored.withColumn("_w", whole).withColumns({f"prob_{k}": F.when(F.col("_w") > 0, F.col(f"prob_{k}") / F.col("_w")).otherwise(0.0) for k in kinds})
    top = F.greatest(*[F.col(f"prob_{k}") for k in kinds])
    label = F.when(top <= 0, "organic").when(F.col("prob_organic") == top, "organic").when(F.col("prob_bot") == top, "bot").otherwise("hub")
    scored = scored.select(LOC, *[f"prob_{k}" for k in kinds], label.alias("predicted"), top.alias("classification_confidence"))
    return df.join(scored, LOC, "left")


def feature_usage(values: dict[str, float], behavioral: list[str], least: float = 0.7) -> dict:
    """Share of importance that behavioural features hold, and whether it is enough."""
    total = sum(values.values())
    share = sum(v for k, v in values.items() if k in behavioral) / total if total else 0.0
    return {"behavioral_share": share, "sufficient": share >= least, "top": list(values)[:20]}
