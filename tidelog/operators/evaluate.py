"""Comparing labels with references and with each other."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.order import exact_quantiles
from tidelog.storage import settled

CLASSES = ("bot", "hub", "organic")
LOC = "geo_location"


def unified(df: DataFrame) -> Column:
    """One label of three from flags."""
    return F.when(F.coalesce("is_bot", F.lit(False)), "bot").when(F.coalesce("is_hub", F.lit(False)), "hub").otherwise("organic")


def matched(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(geo_location, truth, predicted); a location without a prediction is organic."""
    out = truth.select(LOC, "truth").join(predicted.select(LOC, "predicted"), LOC, "left")
    return out.fillna({"predicted": "organic"})


def confusion(rows: DataFrame) -> DataFrame:
    """Counts of each pair of truth and prediction."""
    return rows.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


def class_metrics(rows: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class that occurs."""
    kinds = F.explode(F.array(*[F.lit(c) for c in CLASSES])).alias("label")
    long = rows.select(kinds, (F.col("truth")).alias("t"), F.col("predicted").alias("p"))
    count = lambda c: F.count_if(c)
    out = long.groupBy("label").agg(
        count((F.col("t") == F.col("label")) & (F.col("p") == F.col("label"))).alias("tp"),
        count((F.col("t") != F.col("label")) & (F.col("p") == F.col("label"))).alias("fp"),
        count((F.col("t") == F.col("label")) & (F.col("p") != F.col("label"))).alias("fn"),
        count(F.col("t") == F.col("label")).alias("support"),
    )
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b)), F.lit(0.0))
    out = out.withColumn("precision", part("tp", "fp")).withColumn("recall", part("tp", "fn"))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def macro(metrics: DataFrame) -> DataFrame:
    """One row: mean precision, recall and F1 over the classes."""
    return metrics.agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def agreement(rows: DataFrame, a: str = "truth", b: str = "predicted") -> DataFrame:
    """One row: share of equal labels, Cohen's kappa, and the Jaccard index of each class."""
    n = F.count(F.lit(1))
    chance = sum((F.count_if(F.col(a) == c) / n * (F.count_if(F.col(b) == c) / n) for c in CLASSES), F.lit(0.0))
    same = F.count_if(F.col(a) == F.col(b)) / n
    jaccard = {
        f"jaccard_{c}": F.coalesce(
            F.try_divide(F.count_if((F.col(a) == c) & (F.col(b) == c)).cast("double"), F.count_if((F.col(a) == c) | (F.col(b) == c))), F.lit(0.0)
        )
        for c in CLASSES
    }
    out = rows.agg(n.alias("items"), same.alias("agreement"), chance.alias("_c"), *[x.alias(k) for k, x in jaccard.items()])
    kappa = F.when(F.col("_c") < 1, (F.col("agreement") - F.col("_c")) / (1 - F.col("_c"))).otherwise(1.0)
    return out.withColumn("kappa", kappa).drop("_c")


def mcnemar(rows: DataFrame, a: str, b: str, truth: str = "truth") -> DataFrame:
    """One row: outcomes of two methods against the truth, chi-squared with continuity correction, and its p-value."""
    right_a, right_b = F.col(a) == F.col(truth), F.col(b) == F.col(truth)
    out = rows.agg(
        F.count_if(right_a & right_b).alias("both_right"),
        F.count_if(right_a & ~right_b).alias("only_a"),
        F.count_if(~right_a & right_b).alias("only_b"),
        F.count_if(~right_a & ~right_b).alias("neither"),
    )
    off = F.abs(F.col("only_a") - F.col("only_b")) - 1
    n = F.col("only_a") + F.col("only_b")
    out = out.withColumn("chi2", F.coalesce(F.try_divide((F.greatest(off, F.lit(0)) * F.greatest(off, F.lit(0))).cast("double"), n), F.lit(0.0)))
    return out.withColumn("p_value", upper_tail(F.col("chi2")))


def upper_tail(chi2: Column, terms: int = 200) -> Column:
    """Upper tail of chi-squared with one degree of freedom: one less the error function at sqrt(chi2 / 2).

    The function's series of positive terms converges within double precision up to 36; beyond,
    the tail is below it and 0 to ten places and more.
    """
    half = F.least(chi2 / 2, F.lit(36.0))
    begin = F.struct(F.sqrt(half).alias("term"), F.sqrt(half).alias("sum"))
    grow = lambda s, i: s["term"] * 2 * half / (2 * i + 1)
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), begin, lambda s, i: F.struct(grow(s, i).alias("term"), (s["sum"] + grow(s, i)).alias("sum")), lambda s: s["sum"]
    )
    return F.greatest(1 - 2 / math.sqrt(math.pi) * F.exp(-half) * total, F.lit(0.0))


def p_value(chi2: float) -> float:
    """Upper tail of chi-squared with one degree of freedom."""
    return math.erfc(math.sqrt(max(chi2, 0.0) / 2))


def bootstrap_f1(cells: dict[tuple[str, str], int], rounds: int = 1000, seed: int = 42) -> tuple[float, float, float]:
    """Macro F1 and its 95 percent interval from the nine cells of a confusion table."""
    keys = [(t, p) for t in CLASSES for p in CLASSES]
    counts = np.array([cells.get(k, 0) for k in keys], dtype=float)
    total = int(counts.sum())
    if not total:
        return 0.0, 0.0, 0.0

    def f1(table):
        m = table.reshape(3, 3)
        hit = np.diag(m)
        both = m.sum(axis=0) + m.sum(axis=1)
        return float(np.mean(np.divide(2 * hit, both, out=np.zeros(3), where=both > 0)))

    draws = np.random.default_rng(seed).multinomial(total, counts / total, size=rounds)
    low, high = np.percentile([f1(d.astype(float)) for d in draws], [2.5, 97.5])
    return f1(counts), float(low), float(high)


def discovery(rows: DataFrame, methods: list[str], kind: str) -> DataFrame:
    """One row for a class: items that all, most, or exactly one of the methods give it."""
    votes = sum((F.when(F.col(m) == kind, 1).otherwise(0) for m in methods), F.lit(0))
    k = len(methods)
    rows = rows.withColumn("votes", votes)
    return rows.agg(
        F.count_if(F.col("votes") == k).alias("consensus"),
        F.count_if(F.col("votes") * 2 > k).alias("majority"),
        F.count_if(F.col("votes") == 1).alias("unique"),
        F.count_if(F.col("votes") > 0).alias("any"),
        *[F.count_if((F.col("votes") == 1) & (F.col(m) == kind)).alias(f"only_{m}") for m in methods],
    )


def impact(labelled: DataFrame) -> DataFrame:
    """Locations and events of each label, with their shares."""
    rows = labelled.groupBy(unified(labelled).alias("label")).agg(F.count(F.lit(1)).alias("locations"), F.sum("total_downloads").alias("downloads"))
    every = Window.partitionBy(F.lit(0))
    return rows.withColumn("location_share", F.col("locations") / F.sum("locations").over(every)).withColumn(
        "download_share", F.col("downloads") / F.sum("downloads").over(every)
    )


def confidence_quantiles(labelled: DataFrame, column: str = "classification_confidence") -> DataFrame:
    """(label, mean, q25, q50, q75) of a column."""
    rows = settled(labelled.select(unified(labelled).alias("label"), F.col(column).alias("x")))
    found = exact_quantiles(rows, "x", [0.25, 0.5, 0.75], ["label"]).select("label", *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("q25", "q50", "q75"))])
    return rows.groupBy("label").agg(F.avg("x").alias("mean")).join(F.broadcast(found), "label", "left")
